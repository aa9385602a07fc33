"""Quality rules: a table of thresholds compiled into one projection of Spark expressions.

No user function runs: length, symbol, stop-word, line and repetition counts are built-in expressions over each
document alone, so that there is no shuffle, and any executor can redo any part. Defined results: a null text counts as
empty; an empty text has no words, fails the base rule and is not kept; long texts are counted whole (repetition is
found by sorting a text's own windows); repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

# Frequent function words of the languages, for the stop-word rule.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "with", "have", "be", "it", "was", "for", "on", "are", "as", "this",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "für", "auf", "im", "des", "dem",
    "le", "la", "les", "et", "est", "un", "une", "que", "dans", "pour", "qui", "en", "du", "par", "au", "sur", "avec",
    "el", "los", "las", "y", "es", "una", "por", "con", "no", "para", "su", "lo", "se", "del", "al", "de", "o", "un",
]

SPACE = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric / per <= high; per is 1 if empty. A zero denominator counts as one."""

    name: str
    metric: str
    per: str = ""
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        """Ratios are compared as products of whole numbers and thousandths: exact in every engine."""
        of = F.greatest(F.col(self.per), F.lit(1)) if self.per else F.lit(1)
        out = F.lit(True)
        if self.low is not None:
            out = out & (F.col(self.metric) * 1000 >= of * round(self.low * 1000))
        if self.high is not None:
            out = out & (F.col(self.metric) * 1000 <= of * round(self.high * 1000))
        return out

    def sql(self) -> str:
        of = f"greatest({self.per}, 1)" if self.per else "1"
        parts = [f"{self.metric} * 1000 >= {of} * {round(self.low * 1000)}"] if self.low is not None else []
        parts += [f"{self.metric} * 1000 <= {of} * {round(self.high * 1000)}"] if self.high is not None else []
        return " AND ".join(parts) or "true"


RULES = (
    Rule("length", "n_words", low=50, high=100_000),
    Rule("mean_word", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("letters", "n_letter_words", "n_words", low=0.8),
    Rule("lines_repeated", "n_dup_lines", "n_lines", high=0.4),
    Rule("lines_bulleted", "n_bullets", "n_lines", high=0.9),
    Rule("lines_trailing_off", "n_ellipses", "n_lines", high=0.3),
    Rule("words_repeated", "n_repeat_words", "n_words", high=0.5),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules speak of. Arrays that several counts need are columns of an inner projection."""
    t, w, lines, v, order, p = fresh(docs, "_t", "_w", "_l", "_v", "_s", "_p")
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({
        w: F.array_remove(F.split(t, SPACE), ""),
        lines: F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0),
    })
    n3 = F.greatest(F.size(w) - 2, F.lit(0))
    join = lambda a, b: F.concat(a, F.lit(" "), b)  # noqa: E731  words have no blank: a joined window is unambiguous
    df = df.withColumn(v, F.zip_with(F.zip_with(F.slice(w, F.lit(1), n3), F.slice(w, F.lit(2), n3), join), F.slice(w, F.lit(3), n3), join))
    n = F.size(v)
    # Only a text with a repeated window is sorted: equal windows become neighbours, which name the positions.
    df = df.withColumn(order, F.when(F.size(F.array_distinct(v)) < n, F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))))
    pairs = F.zip_with(F.slice(order, F.lit(1), n - 1), F.slice(order, F.lit(2), n - 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    df = df.withColumn(p, F.when(F.col(order).isNotNull(), F.array_distinct(F.flatten(F.array_compact(pairs)))))
    covered = F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))
    long = lambda c: c.cast("long")
    return df.withColumns({
        "n_words": long(F.size(w)),
        "word_chars": long(F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))),
        "n_symbols": long(F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))),
        "n_lines": long(F.size(lines)),
        "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
        "n_bullets": long(F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•")))),
        "n_ellipses": long(F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))),
        "n_repeat_words": long(F.coalesce(F.size(covered), F.lit(0))),
        "n_stop_words": long(F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in sorted(set(STOP_WORDS))])))),
        "n_letter_words": long(F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]*\\p{L}[^\\x20\\x09-\\x0D]*"))),
    }).drop(t, w, lines, v, order, p)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with measures, one boolean pass_<rule> for each rule, base_failed and kept."""
    df = measures(docs, text)
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    df = df.withColumns({f"pass_{r.name}": r.passes() for r in rules}).withColumn("base_failed", base)
    kept = ~F.col("base_failed")
    for r in rules:
        kept = kept & F.col(f"pass_{r.name}")
    return df.withColumn("kept", kept)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_letter_words", "n_lines")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select(*COLUMNS)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_KEPT = " AND ".join(f"({r.sql()})" for r in RULES)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, i, ws[i] AS word FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i
      FROM (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d))),
v AS (SELECT rid, i, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS c FROM v WHERE w3 IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS i FROM r, (VALUES (0), (1), (2)) AS o(k)) GROUP BY rid),
wc AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(DISTINCT word) FILTER (word IN ({_STOP})) AS stops,
       count(*) FILTER (regexp_matches(word, '\\p{{L}}')) AS letters FROM w GROUP BY rid),
l AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups,
       count(*) FILTER (substr(ltrim(line, ' '), 1, 1) IN ('-', '*', chr(8226))) AS bullets,
       count(*) FILTER (rtrim(line, ' ') LIKE '%...' OR rtrim(line, ' ') LIKE '%' || chr(8230)) AS ellipses FROM l GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
      (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(stops, 0)::BIGINT AS n_stop_words, coalesce(letters, 0)::BIGINT AS n_letter_words,
      coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(bullets, 0)::BIGINT AS n_bullets, coalesce(ellipses, 0)::BIGINT AS n_ellipses
      FROM d LEFT JOIN wc USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_KEPT} AS kept, n_stop_words, n_letter_words, n_lines FROM b
"""
