"""Text column expressions (P9-P20): answer normalisation, tokens, slicing, argmax, templates.

All JVM built-ins. Unicode contract: whitespace is Python's ``str.split`` set, i.e. Java
``(?U)[\\s\\x1c-\\x1f]``; word characters for the article rule are letters, digits and ``_``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the 32 ASCII punctuation characters (Python string.punctuation), in ASCII order
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# fixed values: English articles removed by answer normalisation
ARTICLES = ("a", "an", "the")

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
_ARTICLE_RE = r"(^|[^\p{L}\p{N}_])(" + "|".join(ARTICLES) + r")(?![\p{L}\p{N}_])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def split_ws(s) -> Column:
    """Python ``str.split()``: whitespace runs separate, no empty tokens (trim, then split: no
    per-token lambda)."""
    # the one empty token that a split can leave is that of a blank text
    return F.array_remove(F.split(F.regexp_replace(_c(s), _EDGE_WS, ""), WHITESPACE), "")


def collapse_ws(s) -> Column:
    """``' '.join(s.split())``."""
    return F.array_join(split_ws(s), " ")


def normalize_answer(s) -> Column:
    """Lower → drop ASCII punctuation → articles to a space → collapse whitespace."""
    x = F.lower(_c(s))
    x = F.translate(x, PUNCTUATION, "")
    x = F.regexp_replace(x, _ARTICLE_RE, "$1 ")
    return collapse_ws(x)


def answer_tokens(s) -> Column:
    """Tokens of the normalised text; empty array for empty or null text."""
    return F.coalesce(split_ws(normalize_answer(s)), F.array().cast("array<string>"))


def lstrip(s) -> Column:
    """Strip leading whitespace (Python ``lstrip``; SQL ``ltrim`` strips spaces only)."""
    return F.regexp_replace(_c(s), r"(?U)^[\s\x1c-\x1f]+", "")


def slice_text(context, start, end) -> Column:
    """``context[start:end]`` with 0-based character offsets (empty when end <= start)."""
    st, en = _c(start), _c(end)
    return F.when(en <= st, F.lit("")).otherwise(F.substring(_c(context), st + 1, en - st))


def argmax(a) -> Column:
    """0-based index of the first maximum (NaN counts as the maximum, as numpy)."""
    arr = _c(a)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def squeeze(a) -> Column:
    """1-element prediction array → scalar."""
    return F.element_at(_c(a), 1)


def threshold_multihot(a) -> Column:
    """P20: logits > 0 → 0/1 array."""
    return F.transform(_c(a), lambda x: (x > 0).cast("int"))


def concat_text(cols: Sequence[str], sep: str = " ") -> Column:
    """Join text columns; a null part is an error (``concat_ws`` would skip it silently)."""
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    return F.when(any_null, F.raise_error(F.lit(f"null in one of {list(cols)}"))).otherwise(
        F.concat_ws(sep, *[F.col(c) for c in cols]))


_FIELD = re.compile(r"\{(\w+)\}")


def fill_template(template: str, mapping: Mapping[str, str | Column] | None = None) -> Column:
    """``"{context} {question} {ending}"`` → concat of literals and columns (parsed once)."""
    mapping = mapping or {}
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = mapping.get(m.group(1), m.group(1))
        parts.append(_c(v))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


# fixed values: text columns of the GLUE tasks
TASK_COLUMNS = {
    "cola": ("sentence",), "mnli": ("premise", "hypothesis"), "mrpc": ("sentence1", "sentence2"), "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"), "rte": ("sentence1", "sentence2"), "sst2": ("sentence",), "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
}


def text_columns(columns: Sequence[str], task: str | None = None, chosen: Sequence[str] | None = None, label: str = "label") -> tuple[str, ...]:
    """P10: the one or two text columns of a table: those ``chosen``, else the task's, else ``sentence1`` and ``sentence2``
    where both are there, else the first two that are neither the label nor an index."""
    wanted = tuple(chosen) if chosen else TASK_COLUMNS.get(task) if task else None
    if wanted is None:
        rest = [c for c in columns if c not in (label, "idx", "id")]
        wanted = ("sentence1", "sentence2") if {"sentence1", "sentence2"} <= set(rest) else tuple(rest[:2])
    absent = [c for c in wanted if c not in columns]
    if absent or not 1 <= len(wanted) <= 2:
        raise ValueError(f"text columns {list(wanted)} of task {task!r} are not in {list(columns)}")
    return wanted


def text_pair(df, task: str | None = None, chosen: Sequence[str] | None = None, label: str = "label"):
    """P10: adds ``text_a`` and ``text_b`` (null for single texts), see :func:`text_columns`."""
    names = text_columns(df.columns, task, chosen, label)
    second = F.col(names[1]) if len(names) > 1 else F.lit(None)
    return df.withColumns({"text_a": F.col(names[0]).cast("string"), "text_b": second.cast("string")})


def choice_templates(question_in_first: bool = False, first: str | None = None, second: str | None = None) -> tuple[str, str]:
    """The templates of a choice's two input texts; the question goes with the context or with the ending."""
    one = first if first is not None else "{context} {question}" if question_in_first else "{context}"
    two = second if second is not None else "{ending}" if question_in_first else "{question} {ending}"
    return one, two


def as_array(col: str, dtype: str) -> Column:
    """Wrap a scalar into a 1-element array; arrays pass through (decided from the schema)."""
    return F.col(col) if dtype.startswith("array") else F.array(F.col(col))


def drop_ignored(gold: str | Column, pred: str | Column, ignore: int = -100) -> Column:
    """Aligned label arrays → array of (gold, pred) without the positions whose gold is ``ignore``.

    Null golds stay: only the ignore index marks a position as not scored. Where the prediction is
    shorter its missing positions are null; positions beyond the gold's are not scored.
    """
    gold, pred = _c(gold), _c(pred)
    pairs = F.transform(gold, lambda g, i: F.struct(g.alias("gold"), F.get(pred, i).alias("pred")))
    return F.filter(pairs, lambda p: ~p["gold"].eqNullSafe(F.lit(ignore)))
