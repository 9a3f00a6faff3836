"""Quality rules, line first, in DataFrame functions only.

Every line with a word is judged by three rules:

* punctuation: the line is a fragment (fewer than ``MIN_LINE_WORDS`` words and no closing mark at
  its end), or ASCII marks make up more than ``MAX_MARK_SHARE`` of its characters;
* navigation: the line is a short row of menu entries (several separators), or consists of menu words;
* boilerplate: the line contains a phrase that page templates repeat, or placeholder text or code.

Failing lines are removed. A document is rejected if the lines removed held more than
``MAX_LOST_SHARE`` of its words, or if a base rule fails.

Defined results: null text counts as empty, has no words and fails the base rules. Repeated rows
give repeated results. Extra columns are kept; a column that has the name of a statistic gives way to
the statistic (``prefix`` keeps both).

All statistics are computed inside the row, so nothing is shuffled and no group is ever formed.
Repeated 3-word windows are found by sorting 64-bit numbers, each made of a window's hash (high
bits) and position (low bits); neighbours with equal hash bits are then compared word by word. Where
such neighbours differ, as hashes of very long texts may, the windows themselves are sorted instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, Query, fresh, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_LINE_WORDS = 4
MAX_MARK_SHARE = 0.12
MAX_LOST_SHARE = 0.5
#: Symbols counted by ``n_symbols``.
SYMBOLS = "#*$%&|<>"
#: What may close a line.
CLOSING = r"""[.!?:;,…。！？"'”’»)\]][\x20\x09-\x0D]*$"""
#: Lower-case phrases of boilerplate lines.
BOILERPLATE = (
    "lorem ipsum", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "use cookies", "uses cookies", "enable javascript", "javascript is disabled", "subscribe to our newsletter",
    "click here", "read more", "powered by", "back to top", "share this",
)
#: Lower-case words that only menus put together on a line.
MENU = ("home", "about", "contact", "login", "log in", "logout", "sign in", "sign up", "register", "menu", "search", "faq", "sitemap", "next", "previous", "help", "back")

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


class _Windows:
    """The 3-word windows of ``words``. order: each window's hash, its high bits above ``shift`` bits of position, ascending."""

    def __init__(self, words: Column, order: Column, shift: Column):
        self.words, self.order, self.shift, self.n = words, order, shift, F.size(order)
        self.mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1

    def place(self, i: Column) -> Column:
        return F.element_at(self.order, i.cast("int")).bitwiseAND(self.mask)

    def equal_hash(self, i: Column, j: Column) -> Column:
        high = lambda k: F.call_function("shiftright", F.element_at(self.order, k.cast("int")), self.shift)
        return high(i) == high(j)

    def equal_words(self, i: Column, j: Column) -> Column:
        p, q = self.place(i).cast("int"), self.place(j).cast("int")
        word = lambda k, d: F.get(self.words, k + d)
        return (word(p, 0) == word(q, 0)) & (word(p, 1) == word(q, 1)) & (word(p, 2) == word(q, 2))

    def collide(self) -> Column:
        """Whether different windows that stand side by side have equal hash bits: equal windows may then stand apart."""
        return F.exists(F.sequence(F.lit(2), F.greatest(self.n, F.lit(2))), lambda i: F.coalesce(self.equal_hash(i, i - 1) & ~self.equal_words(i, i - 1), F.lit(False)))

    def by_words(self) -> Column:
        """The windows themselves with their places, in order."""
        at = lambda x: x.bitwiseAND(self.mask)
        return F.sort_array(F.transform(self.order, lambda x: F.struct(*(F.get(self.words, at(x).cast("int") + d).alias(f"w{d}") for d in range(3)), at(x).alias("at"))))

    def repeated(self, sorted_windows: Column) -> Column:
        """Words covered by windows that occur twice or more. sorted_windows: ``by_words`` where hashes collide, else null."""
        window = lambda i: F.element_at(sorted_windows, i.cast("int"))
        by_hash = self._covered(lambda i, j: self.equal_hash(i, j) & self.equal_words(i, j), self.place)
        by_words = self._covered(lambda i, j: (window(i)["w0"] == window(j)["w0"]) & (window(i)["w1"] == window(j)["w1"]) & (window(i)["w2"] == window(j)["w2"]), lambda i: window(i)["at"])
        return F.when(self.n < 2, F.lit(0).cast("long")).when(sorted_windows.isNull(), by_hash).otherwise(by_words)

    def _covered(self, same, place) -> Column:
        n = self.n
        places = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: F.coalesce((i > 1) & same(i, F.greatest(i - 1, F.lit(1))), F.lit(False)) | F.coalesce((i < n) & same(i, F.least(i + 1, n)), F.lit(False)),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: place(i) + d))))).cast("long")


def _template_marks(text: Column) -> Column:
    """False only if no line of the text can be boilerplate: a cheap look at the text as a whole."""
    lower = F.lower(text)
    found = F.contains(lower, F.lit("{")) | F.contains(lower, F.lit("}")) | F.contains(lower, F.lit("function("))
    for phrase in BOILERPLATE:
        found = found | F.contains(lower, F.lit(phrase))
    return found


def _line_fails(line: Column, marked: Column) -> Column:
    """marked: ``_template_marks`` of the whole text."""
    few = ~line.rlike(rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{MIN_LINE_WORDS - 1}}}[^\x20\x09-\x0D]")
    punctuation = (few & ~line.rlike(CLOSING)) | (F.regexp_count(line, F.lit(r"[!-/:-@\[-`{-~]")) > F.lit(MAX_MARK_SHARE) * F.length(line))
    separators = F.regexp_count(line, F.lit("[|›»•·]"))
    entry = rf"(?:{'|'.join(MENU)})"
    navigation = ((separators >= 3) & (separators * 4 >= F.size(_words(line)))) | line.rlike(
        rf"(?i)^[\x20\x09-\x0D]*{entry}(?:[\x20\x09-\x0D|/>›»•·-]+{entry})*[\x20\x09-\x0D]*$"
    )
    boilerplate = marked & F.lower(line).rlike("|".join(BOILERPLATE) + r"|[{}].*[;=(]|function\(")
    return navigation | punctuation | boilerplate


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the five statistics, n_lost_words, base_failed and kept, their names after ``prefix``.

    The statistics come out of a generator, so no filter or projection on them is ever merged into the
    expressions that compute them, where it would have each written out many times.
    """
    names = {c: f"{prefix}{c}" for c in (*STATISTICS, "n_lost_words", "base_failed", "kept")}
    own = [c for c in docs.columns if c.lower() not in {x.lower() for x in names.values()}]
    t, w, ln, o, sh, mk, sw = (fresh([*docs.columns, *names.values()], c) for c in ("text", "words", "lines", "order", "shift", "marked", "windows"))
    out = docs.select(*own, F.coalesce(docs[text], F.lit("")).alias(t))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    out = out.withColumns({w: _words(F.col(t)), ln: lines})
    words = F.col(w)
    n = F.size(words)
    shift = F.length(F.bin(n.cast("long"))).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
    packed = F.transform(
        words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))
    )
    order = F.sort_array(F.slice(packed, 1, F.greatest(n - 2, F.lit(0))))
    out = out.withColumns({o: order, sh: shift, mk: _template_marks(F.col(t))})
    windows = _Windows(words, F.col(o), F.col(sh))
    out = out.withColumn(sw, F.when((windows.n >= 2) & windows.collide(), windows.by_words()))
    found = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(F.col(t), F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size(F.col(ln)) - F.size(F.array_distinct(F.col(ln)))).cast("long"),
        "n_repeat_words": windows.repeated(F.col(sw)),
        "n_lost_words": F.aggregate(
            F.filter(F.col(ln), lambda x: _line_fails(x, F.col(mk))), F.lit(0).cast("long"), lambda total, x: total + F.size(_words(x))
        ),
    }
    out = out.select(*own, F.inline(F.array(F.struct(*(c.alias(names[k]) for k, c in found.items())))))
    n_words, repeated = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    return out.withColumn(names["base_failed"], failed).withColumn(names["kept"], ~failed & (F.col(names["n_lost_words"]) <= F.lit(MAX_LOST_SHARE) * n_words))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns and their original text."""
    prefix = fresh((c[:7] for c in docs.columns), "rules")
    return measure(docs, text, prefix).where(f"`{prefix}kept`").select(*docs.columns)


def clean_text(text: Column) -> Column:
    """The text without its failing lines; null for null.

    No query or stage calls this: they drop documents, and those kept have their original text.
    """
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: (F.trim(x, F.lit(SPACES)) == "") | ~_line_fails(x, F.lit(True))), "\n")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select("doc_id", *STATISTICS, "base_failed", "kept", "n_lost_words")


QUERIES: dict[str, Query] = {"op2_quality_rules": op2_quality_rules}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_MARK = r"[!-/:-@\[-`{-~]"
_MENU = rf"(?i)^{_SPACE}*(?:{'|'.join(MENU)})(?:[\x20\x09-\x0D|/>›»•·-]+(?:{'|'.join(MENU)}))*{_SPACE}*$"
_TEMPLATE = "|".join(BOILERPLATE) + r"|[{}].*[;=(]|function\("


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


#: The rules once more, set by set: words, windows and lines as rows of their own.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, {_sql(_WORD + "+")}) AS ws FROM docs)
),
per_word AS (SELECT r, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM words GROUP BY r),
windows AS (
  SELECT r, i, word AS a, lead(word) OVER (PARTITION BY r ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM words
),
repeated AS (SELECT r, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
per_window AS (
  SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY r
),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, {_sql(_WORD)})),
judged AS (
  SELECT r, line, len(regexp_extract_all(line, {_sql(_WORD + "+")})) AS n,
    len(regexp_extract_all(line, {_sql(_MARK)})) AS marks,
    len(regexp_extract_all(line, '[|›»•·]')) AS separators
  FROM lines
),
per_line AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
    CAST(sum(CASE WHEN (n < {MIN_LINE_WORDS} AND NOT regexp_matches(line, {_sql(CLOSING)}))
        OR marks > CAST({MAX_MARK_SHARE} AS DOUBLE) * length(line)
        OR (separators >= 3 AND separators * 4 >= n)
        OR regexp_matches(line, {_sql(_MENU)})
        OR regexp_matches(lower(line), {_sql(_TEMPLATE)})
      THEN n ELSE 0 END) AS BIGINT) AS n_lost_words
  FROM judged GROUP BY r
),
counted AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    len(regexp_extract_all(t, {_sql(f"[{SYMBOLS}]")})) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words
  FROM docs LEFT JOIN per_word USING (r) LEFT JOIN per_window USING (r) LEFT JOIN per_line USING (r)
),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_lost_words <= CAST({MAX_LOST_SHARE} AS DOUBLE) * n_words AS kept FROM based
"""
}
