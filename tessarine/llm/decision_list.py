"""Quality rules: base counts, and a learned decision list, with DataFrame operations alone.

Sequential covering: on labelled documents, one aggregation counts good and bad rows under every threshold of every
feature; the condition with the best gain joins the conjunction, until the conjunction is pure or long enough; conditions
that don't help on the pruning third are taken off; the rule's rows are set aside and the next rule grows on what is left.
The rules, in order, become one conditional expression: the first one that holds rejects, no rule keeps.

Only statistics come to the driver: per step at most features x (cuts + 1) counts, whatever the size of the input.

Nulls: a null text has no words; labels that are null, or of null ids, are ignored; a document with several labels takes
the lowest. Without labels of both kinds the list is empty and the base rules decide alone. Rows are judged one by one, so
equal rows get equal verdicts. reject_documents() keeps all columns of docs, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, dropped, unused, whole_text, words, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: name: what it is, per mille or a count; all are integers, so thresholds are exact.
FEATURES = ("symbols", "dup_lines", "repeats", "capitals", "marks", "digits", "word_length", "distinct", "words")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CUTS, MOST_RULES, MOST_CONDITIONS, LEAST_ROWS, LEAST_PRECISION = 24, 8, 3, 20, 0.8


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with the base counts and the features' inputs (BASE and COUNTED, which replace columns of these names); the text
    is read once."""
    text = whole_text()
    words_, lines_, windows_, starts_, barrier_ = (unused(c, docs.columns) for c in ("_words", "_lines", "_windows", "_starts", "_barrier"))
    out = docs.withColumn(words_, words(text)).withColumn(lines_, F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    third = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    size = F.size(words_)
    # the windows' hashes beside their places, sorted: equal windows are neighbours
    windows = F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.struct(third(F.col(words_), i).alias("h"), i.alias("i"))))
    out = out.withColumn(windows_, F.sort_array(windows))
    twice = F.filter(windows_, lambda x, k: F.coalesce(F.get(F.col(windows_), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col(windows_), k + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn(starts_, F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform(starts_, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col(starts_), k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    chars = F.length(text)
    out = out.withColumns(
        {
            "n_words": size.cast("long"),
            "word_chars": F.length(F.array_join(words_, "")).cast("long"),
            "n_symbols": (chars - F.length(_without(text, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_n_lines": F.size(lines_).cast("long"),
            "_capitals": (chars - F.length(F.regexp_replace(text, "[\\p{Lu}]+", ""))).cast("long"),
            "_marks": (chars - F.length(_without(text, "!?"))).cast("long"),
            "_digits": (chars - F.length(F.regexp_replace(text, "[0-9]+", ""))).cast("long"),
            "_distinct": F.size(F.array_distinct(words_)).cast("long"),
            barrier_: F.monotonically_increasing_id(),
        }
    )
    # the counts lean on a column that isn't deterministic: else a filter on them would be pushed below the arrays, and
    # these worked out anew for every word
    guarded = {c: F.when(F.col(barrier_) >= 0, F.col(c)) for c in (*BASE, *COUNTED)}
    return out.drop(words_, lines_, windows_, starts_).withColumns(guarded).drop(barrier_)


COUNTED = ("_n_lines", "_capitals", "_marks", "_digits", "_distinct")


def features() -> dict[str, Column]:
    """The features as expressions of with_counts()'s columns: integers, ratios in per mille rounded down."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"({a} * 1000) div {b}")).otherwise(F.lit(0).cast("long"))

    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "_n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("_capitals", "word_chars"),
        "marks": share("_marks", "n_words"),
        "digits": share("_digits", "word_chars"),
        "word_length": share("word_chars", "n_words"),
        "distinct": share("_distinct", "n_words"),
        "words": F.col("n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


Condition = tuple[str, str, int]  #: feature, ">" or "<=", threshold


def condition(c: Condition, columns: dict[str, Column] | None = None) -> Column:
    x = (columns or features())[c[0]]
    return x > c[2] if c[1] == ">" else x <= c[2]


def conjunction(rule: list[Condition], columns: dict[str, Column] | None = None) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & condition(c, columns)
    return out


def verdict(rules: list[list[Condition]], columns: dict[str, Column] | None = None) -> Column:
    """True for keep: the rules in order, the first that holds rejects."""
    out = None
    for rule in rules:
        out = F.when(conjunction(rule, columns), False) if out is None else out.when(conjunction(rule, columns), False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn(labelled: DataFrame, most_rules: int = MOST_RULES, least_rows: int = LEAST_ROWS, least_precision: float = LEAST_PRECISION) -> list[list[Condition]]:
    """The rules from labelled rows: the columns FEATURES, bad (0 or 1) and prune (true for the pruning rows).

    Every step aggregates all rows; gain is bad rows covered times the growth of log precision.
    """
    names = [f for f in FEATURES if f in labelled.columns]
    cuts = labelled.agg(*[F.percentile(f, [(k + 1) / (CUTS + 1) for k in range(CUTS)]).alias(f) for f in names], *[F.min(f).alias(f"_{f}") for f in names]).first()
    # of rows of each kind, so that thresholds lie also where the rare kind is
    bad_cuts = labelled.where("bad = 1").agg(*[F.percentile(f, [(k + 1) / (CUTS + 1) for k in range(CUTS)]).alias(f) for f in names]).first()
    grid = {f: sorted({math.floor(x) for row in (cuts, bad_cuts) for x in (row[f] or [])} | ({cuts[f"_{f}"]} if cuts[f"_{f}"] is not None else set())) for f in names}
    names = [f for f in names if grid[f]]
    if not names:
        return []
    # from here on a feature is the number of its thresholds that it exceeds
    bins = [sum([F.when(F.col(f) > t, 1).otherwise(0) for t in grid[f]], F.lit(0)).alias(f) for f in names]
    rows = written(labelled.select("bad", "prune", *bins), "rule-bins")

    def holds(c: Condition) -> Column:
        k = grid[c[0]].index(c[2])
        return F.col(c[0]) > k if c[1] == ">" else F.col(c[0]) <= k

    def all_hold(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & holds(c)
        return out

    one = lambda x: F.sum(x.cast("long"))
    long_form = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in names])).alias("at")
    rules: list[list[Condition]] = []
    left = F.lit(True)
    for _ in range(most_rules):
        rule: list[Condition] = []
        on_pruning: list[tuple[int, int]] = []
        while len(rule) < MOST_CONDITIONS:
            by_bin = rows.where(left & all_hold(rule)).select("bad", "prune", long_form).groupBy("at.feature", "at.bin")
            grow, cut = ~F.col("prune"), F.col("prune")
            counts = by_bin.agg(one(grow & (F.col("bad") == 1)).alias("bad"), one(grow).alias("all"), one(cut & (F.col("bad") == 1)).alias("pbad"), one(cut).alias("pall")).collect()
            best = _best(counts, grid, least_rows)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            on_pruning.append(best[2][2:])
            if best[2][0] == best[2][1]:
                break
        # reduced-error pruning: the shortest prefix of the best precision on the pruning rows
        scores = [((b + 1) / (n + 2), -k) for k, (b, n) in enumerate(on_pruning)]
        if not scores or max(scores)[0] < least_precision:
            break
        rule = rule[: 1 - max(scores)[1]]
        rules.append(rule)
        left = left & ~all_hold(rule)
    dropped(rows)
    return rules


def _best(rows: list, grid: dict[str, list[int]], least_rows: int) -> tuple[float, Condition, tuple[int, int, int, int]] | None:
    """The condition of the largest gain from counts by feature and bin, with (bad, all) on growing and pruning rows."""
    best = None
    for f in sorted({r["feature"] for r in rows}):
        by = {r["bin"]: (r["bad"], r["all"], r["pbad"], r["pall"]) for r in rows if r["feature"] == f}
        total = tuple(map(sum, zip(*by.values(), strict=True)))
        if not total[0] or total[0] == total[1]:
            continue
        below = (0, 0, 0, 0)
        for k, t in enumerate(grid[f]):
            below = tuple(a + b for a, b in zip(below, by.get(k, (0, 0, 0, 0)), strict=True))
            above = tuple(a - b for a, b in zip(total, below, strict=True))
            for op, (b, n, pb, pn) in (("<=", below), (">", above)):
                if n < least_rows or not b or n == total[1]:
                    continue
                gain = b * (math.log2(b / n) - math.log2(total[0] / total[1]))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, (f, op, t), (b, n, pb, pn))
    return best


def learn_from_labels(counted: DataFrame, labels: DataFrame, held_out: bool = True) -> list[list[Condition]]:
    """The rules from documents with counts and their labels; base failures teach nothing.

    held_out leaves out the rows whose crc32(doc_id as text) mod 4 is 2, for an honest measure.
    """
    quality = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").alias("_quality"))
    known = counted.where(~base_failed()).join(quality, F.col("doc_id") == F.col("_label_id"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = known.where(crc % 4 != 2) if held_out else known
    columns = {f: x.alias(f) for f, x in features().items()}
    rows = written(known.select(*columns.values(), F.when(F.col("_quality") == 0, 1).otherwise(0).alias("bad"), (F.shiftright(crc, 2) % 3 == 0).alias("prune")), "rule-rows")
    rules = learn(rows)
    dropped(rows)
    return rules


def judged(counted: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """counted with base_failed and kept."""
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def reject_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    only_ids = labels.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    sample = docs.select("doc_id", "text").join(only_ids, "doc_id", "left_semi")
    counts = written(with_counts(sample).drop("text"), "rule-counts")
    rules = learn_from_labels(counts, labels)
    dropped(counts)
    own = docs.select(F.struct("*").alias("_own"), F.col("text"))
    return judged(with_counts(own), rules).where("kept").select("_own.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = written(with_counts(docs).drop("text"), "rule-counts")
    rules = learn_from_labels(counted, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(counted, rules).select("doc_id", *BASE, "base_failed", "kept")
