"""What each feature may be used for."""

from __future__ import annotations

from dataclasses import dataclass

# The features by use.
NEVER_EXPOSE = (
    "entity_id tmdb_id mal_id source_id source title original_title alternative_titles discovered_from source_presence match_confidence"
).split()
DIRECT_QUESTION = (
    "media_type genres original_language origin_country status source_material themes demographics studios production_companies production_countries"
).split()
TRANSFORMED_QUESTION = "release_year release_date end_date runtime num_episodes rating".split()
NLP_DERIVED = "overview keywords".split()
LEARNING_ONLY = "vote_count popularity rank favorites num_list_users source_media_type relations".split()

USES = {
    "never_expose": NEVER_EXPOSE,
    "direct_question": DIRECT_QUESTION,
    "transformed_question": TRANSFORMED_QUESTION,
    "nlp_derived": NLP_DERIVED,
    "learning_only": LEARNING_ONLY,
}
#: Uses of which questions may be asked.
ASKABLE = ("direct_question", "transformed_question", "nlp_derived")


@dataclass(frozen=True)
class Registry:
    """Uses of features; unknown ones count as leaks and have no use."""

    uses: dict[str, str]

    def use(self, feature: str) -> str:
        """The use of a feature; KeyError if it is unknown."""
        if feature not in self.uses:
            raise KeyError(f"unknown feature {feature!r}")
        return self.uses[feature]

    def leaks(self, feature: str) -> bool:
        """Whether asking about the feature would give the answer away; true of unknown features."""
        return self.uses.get(feature, "never_expose") == "never_expose"

    def askable(self, feature: str) -> bool:
        """Whether questions may be asked about the feature."""
        return self.uses.get(feature) in ASKABLE

    def check(self, feature: str) -> None:
        """Refuse features that leak (ValueError), are for learning only (ValueError) or are unknown (KeyError)."""
        use = self.use(feature)
        if use == "never_expose":
            raise ValueError(f"LEAKAGE PROTECTION ERROR: {feature} must not be asked about")
        if use == "learning_only":
            raise ValueError(f"GAMEPLAY RESTRICTION ERROR: {feature} is for learning only")

    def features(self, use: str | None = None) -> list[str]:
        """The features, or those of one use."""
        return [f for f, u in self.uses.items() if use in (None, u)]


DEFAULT = Registry({feature: use for use, features in USES.items() for feature in features})
