"""Named similarities and comparison specifications: the extension point of pair comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import keys, similarity, text, typed

#: Similarity of two Columns by name. ``register`` adds own ones: any function
#: of two Columns, which may wrap a SQL function or a pandas UDF.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "exact": similarity.exact, "jaccard": similarity.jaccard, "dice": similarity.dice, "jaro": similarity.jaro,
    "jaro_winkler": similarity.jaro_winkler, "bag": similarity.bag, "edit": similarity.edit, "ratio": similarity.ratio,
    "cosine": similarity.cosine, "tfidf": similarity.cosine_maps, "set_jaccard": similarity.set_jaccard, "set_dice": similarity.set_dice,
    "num_equal": typed.num_equal, "abs_diff": typed.abs_diff, "letter_jaccard": typed.letter_jaccard, "word_jaccard": typed.word_jaccard,
    "relaxed_jaccard": typed.relaxed_jaccard, "containment": typed.containment, "levenshtein": typed.levenshtein_sim,
    "missing": typed.missing_flag, "overlap": typed.overlap, "day_diff": typed.day_diff, "month_diff": typed.month_diff, "year_diff": typed.year_diff,
}
KEYS: dict[str, Callable[..., Column]] = {"simple": keys.simple, "phonetic": keys.phonetic, "slk": keys.slk}
#: Similarities on q-gram sets are computed on sets that are made once per record.
_ON_GRAMS = {"jaccard": similarity.set_jaccard, "dice": similarity.set_dice}


def register(name: str, fn: Callable[[Column, Column], Column]) -> None:
    """Make a similarity available to specifications."""
    SIMILARITIES[name] = fn


def register_key(name: str, fn: Callable[..., Column]) -> None:
    """Make a blocking key available by name."""
    KEYS[name] = fn


@dataclass(frozen=True)
class Comparison:
    """Which similarity compares attribute ``left`` of one record with ``right`` of the other."""

    fn: str
    left: str
    right: str | None = None


@dataclass(frozen=True)
class ComparisonSpec:
    """A list of comparisons that becomes one feature array."""

    comparisons: Sequence[Comparison]
    q: int = 2
    padding: str = "symmetric"
    _grams: dict = field(default_factory=dict, compare=False)

    def attributes(self) -> list[str]:
        """Attributes in use, in order."""
        return list(dict.fromkeys(a for c in self.comparisons for a in (c.left, c.right or c.left)))

    def prepare(self, records: DataFrame) -> DataFrame:
        """Add absent attributes as empty and one q-gram set for each attribute that needs it."""
        for a in self.attributes():
            if a not in records.columns:
                records = records.withColumn(a, F.lit(""))
        grams = dict.fromkeys(x for c in self.comparisons if c.fn in _ON_GRAMS for x in (c.left, c.right or c.left))
        return records.withColumns({f"{a}__q": text.qgrams(F.col(a).cast("string"), self.q, self.padding) for a in grams})

    def features(self, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        """The feature array of a pair, given how to reach a column of either side."""
        out = []
        for c in self.comparisons:
            if c.fn in _ON_GRAMS:
                out.append(_ON_GRAMS[c.fn](left(f"{c.left}__q"), right(f"{c.right or c.left}__q")))
            else:
                out.append(SIMILARITIES[c.fn](left(c.left), right(c.right or c.left)))
        return F.array(*(F.coalesce(x.cast("double"), F.lit(0.0)) for x in out))
