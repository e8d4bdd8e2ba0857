"""Quality rules whose thresholds adapt to each language and source.

Per text, integer features are counted (numpy inside ``mapInArrow``, a text at a time). Each feature's distribution is kept, per
language and source, in a log-bucketed quantile sketch: a table of counts by bucket, so that sketches merge by adding counts
and are the same whatever the partitioning.

Thresholds are read from the sketches' tails. Of a rate (symbols a word, repeated lines, repeated words) the last tenth begins at some
value, or at what one occurrence makes of a text of median length, whichever is more; a text fails if its count is beyond what chance makes
of that rate in a text of its own length (Poisson, so many standard deviations). Of the mean length of words, both tails count: a text fails
if it is REACH times farther out than where the tail begins. A group's thresholds are drawn towards its language's, and those
towards all texts', as far as the group is small. Rows are judged by a join with the thresholds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import add_columns, materialize

SYMBOLS = "#*$%&|<>"
#: rate: (count, what it is a share of, occurrences in the least event, the largest per mille at which a tail may begin). A rate that can't pass
#: 1,000 stays able to fail. Three words that come twice make four to six repeated words.
FEATURES = {
    "symbol_rate": ("n_symbols", "n_words", 1, 10_000),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1, 500),
    "repeat_rate": ("n_repeat_words", "n_words", 6, 500),
}
#: Code points in a hundred words.
WORD_LEN = "word_len"
#: What the rates are of; their medians are kept as well.
SIZES = ("n_words", "n_lines")
#: Hundredths of texts in front of the upper tail; standard deviations of a count beyond the tail's rate; and how far beyond a tail's begin the mean word may lie.
TAIL, DEVIATIONS, REACH = 90, 4, 3
#: Texts of the wider group that a group's own are weighed against.
EVIDENCE = 100
#: Groups up to which their fences are broadcast (some 200 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Linear buckets per power of two: relative error of a quantile at most 1/32.
SUB_BITS = 5


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
    _, at, counts = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """Values of COUNTS. Words are runs of anything but space and \\t to \\r; null has none."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    points = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), points, sum(raw.count(c) for c in SYMBOLS.encode()), dup, repeated_words(words), lines


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns of COUNTS; input columns of those names are replaced."""

    def find(texts: list[str | None]) -> dict:
        found = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return {c: found[:, i] for i, c in enumerate(COUNTS)}

    return add_columns(docs, text, ", ".join(f"{c} bigint" for c in COUNTS), find, keep)


def _word_len() -> Column:
    return F.expr("100 * word_chars div greatest(n_words, 1L)")


def bucket(v: Column) -> Column:
    """The least value of v's bucket: v with all but its SUB_BITS + 1 leading bits cleared."""
    spare = F.greatest(F.length(F.bin(v)) - (SUB_BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, spare), spare)


def sketches(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(level, lang, source, feature, bucket, n) over texts with words: level 2 by language and source, 1 by language, 0 over all.

    Texts are read once, into a small table of the finest level, from which the others are added up.
    """
    values = {k: F.expr(f"1000 * {a} div greatest({b}, 1L)") for k, (a, b, _, _) in FEATURES.items()} | {WORD_LEN: _word_len()} | {k: F.col(k) for k in SIZES}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), bucket(v).alias("bucket")) for k, v in values.items()]))
    base = counts.where("n_words > 0").select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), pairs.alias("x"))
    base = materialize(base.groupBy("lang", "source", "x.feature", "x.bucket").agg(F.count("*").alias("n")), "buckets")
    null = F.lit(None).cast("string")
    levels = [
        base.select(F.lit(2).alias("level"), "lang", "source", "feature", "bucket", "n"),
        base.groupBy("lang", "feature", "bucket").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", null.alias("source"), "feature", "bucket", "n"),
        base.groupBy("feature", "bucket").agg(F.sum("n").alias("n")).select(F.lit(0).alias("level"), null.alias("lang"), null.alias("source"), "feature", "bucket", "n"),
    ]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def fences(sketch: DataFrame, reach: int = REACH, evidence: int = EVIDENCE, tail: int = TAIL) -> DataFrame:
    """(lang, source, n_docs, tail_.. of each rate, min_word_len, max_word_len), one row a group."""
    key = ["level", "lang", "source", "feature"]
    w = Window.partitionBy(*key).orderBy("bucket")
    run = sketch.withColumns({"below": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(*key))})
    q = lambda x, name: F.min(F.when(F.col("below") * 100 >= F.col("total") * x, F.col("bucket"))).alias(name)
    tails = run.groupBy(*key).agg(q(100 - tail, "low"), q(50, "mid"), q(tail, "high"), F.max("total").alias("n_docs"))
    of = lambda k: F.max(F.when(F.col("feature") == k, F.struct("low", "mid", "high"))).alias(k)
    wide = tails.groupBy("level", "lang", "source").agg(F.max("n_docs").alias("n_docs"), *[of(k) for k in (*FEATURES, WORD_LEN, *SIZES)])
    limits = [F.expr(f"least(greatest({k}.high, {1000 * least}L div greatest({size}.mid, 1L), 1L), {most}L)").alias(f"tail_{k}") for k, (_, size, least, most) in FEATURES.items()]
    x = WORD_LEN
    limits.append(F.expr(f"greatest({x}.low - {reach} * greatest({x}.mid - {x}.low, {x}.mid div {1 << SUB_BITS}), 0L)").alias(f"min_{x}"))
    limits.append(F.expr(f"{x}.high + {reach} * greatest({x}.high - {x}.mid, {x}.mid div {1 << SUB_BITS})").alias(f"max_{x}"))
    own = wide.select("level", "lang", "source", "n_docs", F.struct(*limits).alias("f"))
    names = [*[f"tail_{k}" for k in FEATURES], f"min_{x}", f"max_{x}"]
    toward = lambda n, a, b: F.struct(*[F.expr(f"({n} * {a}.{x} + {evidence}L * {b}.{x}) div ({n} + {evidence}L)").alias(x) for x in names])
    level = lambda n, *cols: own.where(F.col("level") == n).select(*cols)
    # One row of all texts' thresholds, beside a row for each language.
    langs = level(1, F.col("lang").alias("_l"), F.col("n_docs").alias("n1"), F.col("f").alias("f1")).crossJoin(F.broadcast(level(0, F.col("f").alias("f0"))))
    langs = langs.select("_l", toward("n1", "f1", "f0").alias("f1"))
    groups = level(2, "lang", "source", "n_docs", F.col("f").alias("f2")).join(langs, F.col("lang").eqNullSafe(F.col("_l")))
    return groups.select("lang", "source", "n_docs", toward("n_docs", "f2", "f1").alias("f")).select("lang", "source", "n_docs", "f.*")


def judge(counts: DataFrame, fence: DataFrame, lang: str = "lang", source: str = "source", broadcast: bool = True) -> DataFrame:
    """``counts`` with base_failed, reasons (features beyond a threshold, comma-joined) and kept; input columns of these names are replaced.

    A group without words has no thresholds and fails the base rule. broadcast: the thresholds are known to be few.
    """
    cols = [c for c in counts.columns if c not in ("base_failed", "reasons", "kept")]
    limits = fence.select(F.col("lang").alias("_g_lang"), F.col("source").alias("_g_source"), F.struct(*[c for c in fence.columns if c not in ("lang", "source", "n_docs")]).alias("_f"))
    named = counts.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("_r"), F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source"), *COUNTS)
    rows = named.join(F.broadcast(limits) if broadcast else limits, F.col("_lang").eqNullSafe(F.col("_g_lang")) & F.col("_source").eqNullSafe(F.col("_g_source")), "left")
    over = []
    for k, (a, b, least, _) in FEATURES.items():
        # Squares instead of a root, in doubles: the same rows in any engine.
        ahead, mean = f"(1000.0D * {a} - cast(_f.tail_{k} as double) * {b})", f"cast(_f.tail_{k} as double) * {b}"
        over.append(F.when(F.expr(f"{ahead} > 0 and {ahead} * {ahead} > {DEVIATIONS**2 * 1000 * least}.0D * {mean}"), F.lit(k)))
    over.insert(1, F.when((_word_len() > F.col(f"_f.max_{WORD_LEN}")) | (_word_len() < F.col(f"_f.min_{WORD_LEN}")), F.lit(WORD_LEN)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select("_r", failed.alias("base_failed"), F.array_join(F.array_compact(F.array(*over)), ",").alias("reasons"))
    return rows.select(*[F.col(f"_r.c{i}").alias(c) for i, c in enumerate(cols)], "base_failed", "reasons", (~F.col("base_failed") & (F.col("reasons") == "")).alias("kept"))


def rejections(judged: DataFrame) -> DataFrame:
    """(feature, n, alone): rows that pass the base rule and that a feature rejects, and those that no other rejects."""
    found = judged.where("not base_failed and reasons <> ''").select(F.split("reasons", ",").alias("r"))
    return found.select(F.explode("r").alias("feature"), (F.size("r") == 1).alias("one")).groupBy("feature").agg(F.count("*").alias("n"), F.count_if("one").alias("alone"))


def few_groups(fence: DataFrame) -> tuple[DataFrame, bool]:
    """``fence`` written and read back, and whether it may be broadcast."""
    fence = materialize(fence, "fences")
    return fence, fence.count() <= BROADCAST_GROUPS


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Null and empty texts have no words and fail the base rule. Null languages and sources form groups of their own. Every row
    counts, repeated or not, and is judged alone, so ties don't arise. An empty table gives no rows; very long texts are counted whole.
    Texts are read and counted once, into a written table from which the sketches are made; that table is judged in place while
    the fences can be broadcast, else rows are joined without their texts, which are then joined back by row number.
    """
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.monotonically_increasing_id().alias("_row"))
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    counts = materialize(with_counts(named, at[text]), "counted")
    limits, few = few_groups(fences(sketches(counts, at[lang], at[source])))
    if few:
        passed = judge(counts, limits, at[lang], at[source]).where("kept")
    else:
        narrow = counts.select("_row", at[lang], at[source], *COUNTS)
        passed = counts.join(judge(narrow, limits, at[lang], at[source], broadcast=False).where("kept").select("_row"), "_row", "left_semi")
    return passed.select(*[F.col(v).alias(k) for k, v in at.items()])
