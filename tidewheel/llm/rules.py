"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in SQL expression over the text and RULES is a table of
(measure, low, high); both become columns of a single select, with no user
function, shuffle or join. Repeated eight-word windows are found inside the row:
words are hashed once and windows by their words' hashes; where a hash repeats,
each window's hash and position are packed into one long, the longs are sorted,
and neighbours with equal hash bits are compared word by word.

Edge cases: a null text is one without words; ratios of a text without words are
0; repeated rows each get a row; very long texts are measured whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Stop words of the four languages.
STOP_WORDS = "the of and to in is that for with was on are be it as at by this from der die das und ist zu den von mit nicht ein eine im auf für le la les de des et un une en est que pour dans du sur el los las del y se por con una no es".split()

#: (measure, lowest, highest) that a text may have; None: no limit on that side.
RULES = (
    ("n_words", 20, None),
    ("repeat_ratio", None, 0.30),
    ("mean_word_chars", 2.0, 25.0),
    ("symbol_ratio", None, 0.30),
    ("dup_line_ratio", None, 0.60),
    ("pipe_ratio", None, 0.20),
    ("upper_ratio", None, 0.80),
    ("stop_words", 1, None),
)

#: Columns that later ones use, in order. `words` and the like are dropped.
STEPS = (
    {
        "words": rf"regexp_extract_all(coalesce(text, ''), '{WORD}', 0)",
        "lines": rf"filter(split(coalesce(text, ''), '\n', -1), x -> regexp_like(x, '{WORD}'))",
        "word_chars": r"cast(length(translate(coalesce(text, ''), '\u0009\u000a\u000b\u000c\u000d ', '')) as long)",
        "n_symbols": "cast(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) as long)",
        "upper_chars": "cast(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Z]', '')) as long)",
        "lower_chars": "cast(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[a-z]', '')) as long)",
    },
    {
        "n_words": "cast(size(words) as long)",
        "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as long)",
        "n_lines": "cast(size(lines) as long)",
        "pos_bits": "int(ceil(log2(size(words) + 2)))",
        "n_pipes": "cast(size(filter(words, x -> x = '|')) as long)",
        "stop_words": "cast(size(array_intersect(transform(words, x -> lower(x)), {stop})) as long)",
    },
    {
        "hashes": f"if(n_words > {WINDOW}, transform(words, w -> xxhash64(w)), array())",
    },
    {
        "windows": f"transform(slice(hashes, 1, greatest(0, size(hashes) - {WINDOW - 1})), (h, i) -> xxhash64(h, " + ", ".join(f"get(hashes, i + {k})" for k in range(1, WINDOW)) + "))",
    },
    {
        # Most texts repeat nothing: only those whose windows' hashes do are looked at further.
        "packed": "if(size(array_distinct(windows)) = size(windows), array(), sort_array(transform(windows, (h, i) -> shiftleft(h, pos_bits) | i)))",
    },
    {
        "twice": "filter(sequence(0, size(packed) - 2), j -> size(packed) > 1 and shiftright(get(packed, j), pos_bits) = shiftright(get(packed, j + 1), pos_bits)"
        f" and slice(words, int(get(packed, j) & (shiftleft(1L, pos_bits) - 1)) + 1, {WINDOW}) = slice(words, int(get(packed, j + 1) & (shiftleft(1L, pos_bits) - 1)) + 1, {WINDOW}))",
    },
    {
        "starts": "sort_array(array_distinct(flatten(transform(twice, j -> array(get(packed, j) & (shiftleft(1L, pos_bits) - 1), get(packed, j + 1) & (shiftleft(1L, pos_bits) - 1))))))",
    },
    {
        "n_repeat_words": f"if(size(starts) = 0, 0L, aggregate(sequence(0, size(starts) - 1), 0L, (s, j) -> s + least({WINDOW}L, coalesce(get(starts, j + 1) - get(starts, j), {WINDOW}L))))",
    },
    {
        "base_failed": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
        "mean_word_chars": "if(n_words = 0, 0D, word_chars / greatest(n_words, 1))",
        "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "pipe_ratio": "n_pipes / greatest(n_words, 1)",
        "upper_ratio": "upper_chars / greatest(upper_chars + lower_chars, 1)",
    },
)


def verdict(rules=RULES) -> str:
    """The table as one boolean expression."""
    parts = []
    for measure, low, high in rules:
        parts += [f"{measure} >= {low}"] if low is not None else []
        parts += [f"{measure} <= {high}"] if high is not None else []
    return " and ".join(parts)


def measures(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs' columns in a struct `row`, the measures, base_failed and kept."""
    stop = "array(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
    d = docs.select(F.struct("*").alias("row"), F.col("text"))
    for step in STEPS:
        d = d.withColumns({k: F.expr(v.replace("{stop}", stop)) for k, v in step.items()})
    return d.withColumn("kept", F.expr(f"not base_failed and {verdict(rules)}")).drop("text", "words", "lines", "hashes", "windows", "packed", "twice", "starts", "pos_bits")


def digest(docs: DataFrame) -> DataFrame:
    m = measures(docs.select("doc_id", "text"))
    return m.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    return measures(docs).where("kept").select("row.*")
