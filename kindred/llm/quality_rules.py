"""Quality rules as a learned decision list over text statistics.

Sequential covering learns from labelled documents: a rule grows by the threshold condition with the highest
information gain over the rows not yet covered, is pruned on rows that did not take part in growing it, and is
accepted if it is precise enough there; the rows it covers are removed and the next rule is learned. Each rule is a
conjunction of thresholds that rejects a document, and the list becomes one ordered ``CASE`` expression.

Statistics are columns made of built-in functions, so texts stay where they are: no shuffle carries a text. Learning
reads a small table of numbers; each step is one aggregate whose result has at most features x thresholds rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.texts import SPACE, WORD, materialize, table, words

SYMBOLS = "[#*$%&|<>]"
#: Base rules: documents with fewer words, or with a larger part of repeated words, fail whatever was learned.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: Learning: candidate thresholds per statistic, conditions per rule, rules, and what a rule needs on unseen rows.
THRESHOLDS = 24
MAX_CONDITIONS = 3
MAX_RULES = 12
MIN_PRECISION = 0.9
MIN_COVERED = 5
#: The bits of a packed window that hold its position; a text has fewer than 2^31 words.
POSITION_BITS = 31


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, the base counts and n_upper, n_chars of every whole text; a null text has no words.

    ``n_repeat_words`` counts the words that lie in a window of three words found twice or more in the text, each
    word once. Windows are first compared by 33 bits of their hash, which never separates equal windows, and then,
    where these agree, by their words. ``carry`` names a column to hand through.
    """
    kept = ["id", *(["carried"] if carry else [])]
    base = docs.select(
        F.col(doc_id).alias("id"), *([F.col(carry).alias("carried")] if carry else []), F.coalesce(F.col(text), F.lit("")).alias("raw")
    )
    cut = base.select(
        *kept, "raw", words(F.col("raw")).alias("word"), F.filter(F.split("raw", "\n"), lambda line: line.rlike(WORD)).alias("line")
    )
    counted = cut.select(
        *kept,
        "word",
        F.size("word").alias("n_words"),
        F.length(F.regexp_replace("raw", SPACE + "+", "")).alias("word_chars"),
        F.regexp_count("raw", F.lit(SYMBOLS)).alias("n_symbols"),
        (F.size("line") - F.size(F.array_distinct("line"))).alias("n_dup_lines"),
        F.regexp_count("raw", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.transform("word", lambda w: F.xxhash64(w)).alias("hash"),
    )
    numbers = [*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper"]
    low = (1 << POSITION_BITS) - 1
    windows = counted.select(
        *numbers,
        "word",
        F.sort_array(
            F.transform(
                F.slice("hash", F.lit(1), F.greatest(F.size("hash") - 2, F.lit(0))),
                lambda h, i: F.xxhash64(h, F.get("hash", i + 1), F.get("hash", i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
            )
        ).alias("packed"),
    )

    def same_hash(x: Column, other: Column) -> Column:
        return F.coalesce(F.shiftright(x, POSITION_BITS) == F.shiftright(other, POSITION_BITS), F.lit(False))

    likely = windows.select(
        *numbers,
        "word",
        F.filter(
            "packed", lambda x, i: same_hash(x, F.get("packed", i - 1)) | same_hash(x, F.get("packed", i + 1))
        ).alias("likely"),
    )
    spelled = likely.select(
        *numbers,
        F.sort_array(
            F.transform(
                F.transform("likely", lambda x: x.bitwiseAND(F.lit(low)).cast("int")),
                lambda p: F.struct(
                    F.concat_ws(" ", F.get("word", p), F.get("word", p + 1), F.get("word", p + 2)).alias("window"), p.alias("at")
                ),
            )
        ).alias("spelled"),
    )

    def same_window(x: Column, other: Column) -> Column:
        return F.coalesce(x["window"] == other["window"], F.lit(False))

    repeated = spelled.select(
        *numbers,
        F.sort_array(
            F.transform(
                F.filter(
                    "spelled",
                    lambda x, i: same_window(x, F.get("spelled", i - 1)) | same_window(x, F.get("spelled", i + 1)),
                ),
                lambda x: x["at"],
            )
        ).alias("at"),
    )
    covered = repeated.select(
        *numbers, F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))).alias("covers")
    )
    # One generated row keeps a later filter on these numbers above the expressions they come from: pushed down, it
    # would repeat each of them wherever it is used.
    rows = covered.select(
        *kept,
        F.inline(
            F.array(
                F.struct(
                    *[F.col(c).cast("long").alias(c) for c in numbers[len(kept):]],
                    F.aggregate("covers", F.lit(0).cast("long"), lambda total, n: total + n).alias("n_repeat_words"),
                )
            )
        ),
    )
    renamed = rows.withColumnRenamed("id", "doc_id")
    return renamed.withColumnRenamed("carried", carry) if carry else renamed


def features() -> dict[str, Column]:
    """What rules are made of: columns of ``statistics`` put in relation to the text's length."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "repeated_words": F.col("n_repeat_words") / n,
        "repeated_lines_per_word": F.col("n_dup_lines") / n,
        "capitals_per_char": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document is rejected by the first rule all of whose conditions hold."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def verdict(self) -> Column:
        """The number of the rule that rejects the document, from 1; null if it is kept."""
        case = None
        for number, rule in enumerate(self.rules, 1):
            holds = F.lit(True)
            for condition in rule:
                holds = holds & condition.column()
            case = F.when(holds, F.lit(number)) if case is None else case.when(holds, F.lit(number))
        return F.lit(None).cast("int") if case is None else case

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, rule)) for rule in self.rules)


def learn(labelled: DataFrame, label: str = "good") -> DecisionList:
    """Learns the list from rows of ``statistics`` with a boolean ``label``; rows without a label are left out.

    All labelled rows that pass the base rules take part. Two thirds of them, by their id's hash, grow rules, the rest prunes and accepts
    them. With no rows, or rows of one class only, the list is empty and rejects nothing.
    """
    names = list(features())
    usable = materialize(
        labelled.where(F.col(label).isNotNull() & ~base_failed()).select(
            F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("crc"),
            F.col(label).alias("good"),
            *[value.alias(name) for name, value in features().items()],
        ),
        "quality-labelled",
    )
    steps = [k / (THRESHOLDS + 1) for k in range(1, THRESHOLDS + 1)]
    found = usable.agg(
        *[F.percentile_approx(F.when(~F.col("good"), F.col(n)), steps, 10_000).alias(f"bad_{n}") for n in names],
        *[F.percentile_approx(F.when(F.col("good"), F.col(n)), steps, 10_000).alias(f"good_{n}") for n in names],
    ).first()
    cuts = {n: sorted({*(found[f"bad_{n}"] or []), *(found[f"good_{n}"] or [])}) for n in names}
    if not all(found[f"bad_{n}"] and found[f"good_{n}"] for n in names):
        return DecisionList()

    def cell(name: str) -> Column:
        """How many thresholds the value exceeds."""
        return sum((F.col(name) > t).cast("int") for t in cuts[name])

    cells = materialize(
        usable.select((F.col("crc") % 3 != 0).alias("grows"), "good", *[cell(n).cast("short").alias(n) for n in names])
        .groupBy("grows", "good", *names)
        .agg(F.count("*").alias("n")),
        "quality-cells",
    )

    def holds(rule: tuple[tuple[str, bool, int], ...]) -> Column:
        test = F.lit(True)
        for name, above, k in rule:
            test = test & (F.col(name) > k if above else F.col(name) <= k)
        return test

    def best_condition(rows: DataFrame, used: tuple) -> tuple[str, bool, int] | None:
        by_cell = (
            rows.select("good", "n", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("cell")) for n in names])).alias("f"))
            .groupBy("f.name", "f.cell")
            .agg(F.sum(F.when(~F.col("good"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("fine"))
            .collect()
        )
        counts: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for r in by_cell:
            counts[r["name"]][r["cell"]] = (r["bad"], r["fine"])
        bad = sum(b for b, _ in counts[names[0]].values())
        fine = sum(f for _, f in counts[names[0]].values())
        if not bad or not fine:
            return None
        before, best, choice = math.log2(bad / (bad + fine)), 1e-9, None
        for name in names:
            low_bad = low_fine = 0
            for k in range(len(cuts[name])):
                b, f = counts[name].get(k, (0, 0))
                low_bad, low_fine = low_bad + b, low_fine + f
                for above, p, q in ((False, low_bad, low_fine), (True, bad - low_bad, fine - low_fine)):
                    if p and (name, above, k) not in used and (gain := p * (math.log2(p / (p + q)) - before)) > best:
                        best, choice = gain, (name, above, k)
        return choice

    rules: list[tuple[tuple[str, bool, int], ...]] = []
    left = cells
    while len(rules) < MAX_RULES:
        rule: tuple[tuple[str, bool, int], ...] = ()
        while len(rule) < MAX_CONDITIONS:
            more = best_condition(left.where("grows").where(holds(rule)), rule)
            if more is None:
                break
            rule = (*rule, more)
        if not rule:
            break
        # Prune: the shortest prefix with the best (bad - good) / (bad + good) on the rows kept back.
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        unseen = left.where("not grows").agg(
            *[F.sum(F.when(holds(p) & ~F.col("good"), F.col("n")).otherwise(0)).alias(f"bad{k}") for k, p in enumerate(prefixes)],
            *[F.sum(F.when(holds(p) & F.col("good"), F.col("n")).otherwise(0)).alias(f"fine{k}") for k, p in enumerate(prefixes)],
        ).first()
        scored = [
            (b / (b + f) if b + f else 0.0, b, -k) for k in range(len(prefixes)) for b, f in [(unseen[f"bad{k}"] or 0, unseen[f"fine{k}"] or 0)]
        ]
        precision, covered, k = max(scored)
        if precision < MIN_PRECISION or covered < MIN_COVERED:
            break
        rules.append(prefixes[-k])
        left = left.where(~holds(rules[-1]))
    return DecisionList(tuple(tuple(Condition(n, above, cuts[n][k]) for n, above, k in rule) for rule in rules))


def labelled_statistics(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Statistics of the labelled documents with the column ``good``.

    A document with several labels is good if most of them say so, ties going to good; null ids join nothing.
    """
    votes = (
        labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(doc_id).alias("labelled_id"))
        .agg((F.avg((F.col(quality) > 0).cast("double")) >= 0.5).alias("good"))
    )
    return stats.join(votes, F.col("doc_id") == F.col("labelled_id")).drop("labelled_id")


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds base_failed, rule (number of the rule that rejects the row, null if none) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": rules.verdict()}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither fail the base rules nor are rejected by the list learned from ``labels``.

    Rows keep their columns and may repeat. Null or empty texts have no words and go.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = docs.select(F.col("doc_id"), F.col("text"), row.alias("whole"))
    votes = labels.where("quality is not null").select(F.col("doc_id").alias("labelled_id")).distinct()
    known = statistics(plain.select("doc_id", "text").join(votes, F.col("doc_id") == F.col("labelled_id"), "left_semi"))
    rules = learn(labelled_statistics(known, labels))
    return judge(statistics(plain, carry="whole"), rules).where("kept").select("whole.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether base rules and learned list keep it."""
    stats = materialize(statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    rules = learn(labelled_statistics(stats, table(spark, sf_dir, "labels")))
    judged = judge(stats, rules)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
