"""Operator 4: quality rules, a threshold table compiled into one Spark projection.

RULES names a ratio and the range it must lie in. compile_rules() turns the
table into one Boolean column over a document's measures, and the measures
themselves are built-in functions over the text: no user function runs.
Ratios are compared as whole numbers (a * 1000 against limit * b), so every
engine gives the same verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space between words, symbols, and the shape of a repeated window.
SPACE, SYMBOL, REPEAT = r"[\\x20\\x09-\\x0D]+", r"[^#*$%&|<>]+", 5

#: Common words of English, French, German and Spanish.
STOP_WORDS = "the of and to in is that it for on with as be by at from was this are or de la le les et des en un une du que qui est dans pour au sur par pas der die das und ist von zu den mit ein eine im des dem el los las y del se por con una para".split()


@dataclass(frozen=True)
class Rule:
    """1000 * over must be between low and high times per; texts of fewer than
    `least` words are not judged by it."""

    name: str
    over: str
    per: str
    low: int | None = None
    high: int | None = None
    least: int = 0


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=1500, high=20000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=300),
    Rule("exclamations_per_word", "n_exclaims", "n_words", high=400),
    Rule("stop_words_per_word", "n_stop_words", "n_words", low=10, least=60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
    Rule("mean_words_per_line", "n_words", "n_lines", low=1000),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> str:
    """The verdict of a threshold table as one SQL condition."""
    parts = []
    for r in rules:
        tests = [f"1000 * {r.over} >= {r.low} * {r.per}"] * (r.low is not None) + [f"1000 * {r.over} <= {r.high} * {r.per}"] * (r.high is not None)
        if tests:
            parts.append("(" + f"n_words < {r.least} or " * bool(r.least) + " and ".join(tests) + ")")
    return " and ".join(parts) or "true"


def _let(value: str, name: str, body: str) -> str:
    """Value once, under a name, within body: Spark evaluates a lambda's argument
    once, where a column that is used in a lambda could be put in its place."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _measures(stop_words: list[str]) -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(stop_words))
    grams = f"case when size(w) >= {REPEAT} then {_let('transform(w, x -> xxhash64(x))', 'h', f'transform(sequence(0, size(w) - {REPEAT}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(REPEAT))}))')} else cast(array() as array<bigint>) end"
    twice = "transform(filter(p, (x, i) -> x.h = p[greatest(i - 1, 0)].h and i > 0 or i + 1 < size(p) and x.h = p[least(i + 1, size(p) - 1)].h), x -> x.i)"
    covered = f"aggregate(array_sort({_let('array_sort(transform(g, (x, i) -> struct(x as h, i as i)))', 'p', twice)}), struct(0L as n, -{REPEAT} as last), (a, i) -> struct(a.n + least({REPEAT}, i - a.last) as n, i as last)).n"
    repeats = _let(grams, "g", f"case when size(array_distinct(g)) = size(g) then 0L else {covered} end")
    lines = _let(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')", "l", "struct(size(l) as n, size(l) - size(array_distinct(l)) as dup)")
    words = f"filter(split(t, '{SPACE}'), x -> x <> '')"
    body = f"""named_struct(
        'n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint),
        'n_symbols', cast(length(regexp_replace(t, '{SYMBOL}', '')) as bigint),
        'n_exclaims', cast(length(regexp_replace(t, '[^!]+', '')) as bigint),
        'n_stop_words', cast(size(filter(w, x -> lower(x) in ({stops}))) as bigint),
        'lines', {lines}, 'n_repeat_words', {repeats})"""
    return _let("coalesce(text, '')", "t", _let(words, "w", body))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """The measures, base_failed and kept of each row, in one projection.

    A null or empty text has no words and fails. Texts of any length are judged
    whole. Repeated rows each get their row, a null id is passed through, other
    columns are ignored, and an empty table gives no rows.
    """
    return _judged(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), "id", rules, stop_words)


#: What fails a text whatever the rules say.
_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _judged(rows: DataFrame, keep: str, rules: tuple[Rule, ...], stop_words: list[str]) -> DataFrame:
    """The column `keep`, the measures of the column text, base_failed and kept."""
    m = rows.selectExpr(keep, f"{_measures(stop_words)} as m")
    m = m.selectExpr(keep, "m.n_words", "m.word_chars", "m.n_symbols", "m.n_exclaims", "m.n_stop_words", "cast(m.lines.n as bigint) as n_lines", "cast(m.lines.dup as bigint) as n_dup_lines", "m.n_repeat_words")
    return m.selectExpr("*", f"{_FAILED} as base_failed", f"not ({_FAILED}) and {compile_rules(rules)} as kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their columns. Rows are judged where they stand, so
    rows that repeat an id are judged each by its own text."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["text"].cast("string").alias("text"))
    return _judged(rows, "row", RULES, STOP_WORDS).where("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's measures, and the verdict of RULES for texts that the base does not fail."""
    out = quality(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_exclaims", "n_lines")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (select doc_id, i, w[i:i + 4] as gram from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
c as (select doc_id, sum(least(5, coalesce(i - last, 5))) as n_repeat_words from (select doc_id, i, lag(i) over (partition by doc_id order by i) as last from r) group by doc_id),
m as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(length(regexp_replace(t, '[^!]+', '', 'g')) as bigint) as n_exclaims,
    cast(len(list_filter(w, lambda x: lower(x) in ({_STOPS}))) as bigint) as n_stop_words,
    cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from d left join c on d.doc_id = c.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and {compile_rules()}) as kept,
  n_stop_words, n_exclaims, n_lines
from m
"""
