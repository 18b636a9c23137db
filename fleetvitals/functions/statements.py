"""Statement digests: what is left of a statement without its literals, list lengths, comments and white space.

The result is what the server's own digests keep apart: quoted strings with
either kind of escape, hexadecimal, binary and exponent numbers become `?`,
value lists `(...)`, lists of them `(...) /* , ... */`, and an IN list `IN (...)`
at every length. As on the server a single row of values is no list of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetvitals.functions import scalars as S
from fleetvitals.sources.ingest import let

# Every pattern below is preceded by what a match must begin with or hold: a test of one character, or a search for a
# short text, costs a fraction of trying the pattern at each place of a statement.
_STRING = r"'(?:[^'\\]|\\.|'')*+'|\"(?:[^\"\\]|\\.|\"\")*+\""
_INTRODUCED = rf"(?:\b[xXbBnN]|\b_[a-zA-Z0-9]+\s*)?(?:{_STRING})"
_NUMBER = r"(?:0[xX][0-9a-fA-F]+|0b[01]+|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)(?![\p{L}\p{N}_$@])"
_QUOTED_NAME = r"`(?:[^`]|``)*+`"
_WORD = r"[\p{L}\p{N}_$@]++"
_COMMENT = r"/\*(?!!)(?s:.*?)\*/|--(?=\s|$)[^\n]*|#[^\n]*|/\*!\d*|\*/"
_TOKEN = rf"{_COMMENT}|{_INTRODUCED}|{_QUOTED_NAME}|\s+|\.{_WORD}(?<!\.\d{{1,40}})|{_NUMBER}|{_WORD}|(?s:.)"

# Words of the language, written in capitals in a digest wherever they stand for themselves.
KEYWORDS = (
    "ALL ALTER ANALYZE AND ANY AS ASC BETWEEN BY CALL CASE COLLATE COMMIT COUNT CREATE CROSS DEFAULT DELETE DESC DESCRIBE DISTINCT DIV DO "
    "DROP DUPLICATE ELSE END ESCAPE EXCEPT EXISTS EXPLAIN FALSE FOR FORCE FROM FULL GRANT GROUP HAVING IF IGNORE IN INDEX INNER INSERT "
    "INTERSECT INTERVAL INTO IS JOIN KEY KILL LEFT LIKE LIMIT LOAD LOCK MATCH MOD NATURAL NOT NULL OFFSET ON OPTIMIZE OR ORDER OUTER "
    "OVER PARTITION PRIMARY REGEXP RENAME REPLACE REVOKE RIGHT RLIKE ROLLBACK SELECT SET SHOW SOUNDS STRAIGHT_JOIN TABLE THEN TO TRUE "
    "TRUNCATE UNION UNIQUE UNLOCK UPDATE USE USING VALUE VALUES VIEW WHEN WHERE WINDOW WITH XOR"
).split()
# After these a sign belongs to the number.
_BEFORE_SIGN = r"[=<>(,*/%!|&^~]|\b(?:SELECT|IN|VALUES?|THEN|WHEN|ELSE|LIMIT|OFFSET|BETWEEN|AND|OR|LIKE|SET|BY|WHERE|HAVING|NOT|DIV|MOD)\b"


def _of_tokens(sql: Column) -> Column:
    """Every token in its normal form; needed where names are quoted or comments stand between."""
    words = F.array(*[F.lit(k) for k in KEYWORDS])

    def normal(t: Column) -> Column:
        return (
            F.when(t.rlike(rf"^(?:{_COMMENT}|\s)"), " ")
            .when(t.startswith("`"), t)
            .when(t.rlike(rf"^(?:{_INTRODUCED}|{_NUMBER})"), "?")
            .when(F.array_contains(words, F.upper(t)), F.upper(t))
            .otherwise(t)
        )

    tokens = F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, normal), "")


def _by_patterns(sql: Column) -> Column:
    """The same for a statement without comments, quoted names and keywords in small letters: two replacements."""
    text = F.regexp_replace(sql, rf"(?=['\"\d._xXbBnN])(?:{_INTRODUCED}|(?<![\p{{L}}\p{{N}}_$@]){_NUMBER})", "?")
    return F.regexp_replace(text, r"\s+", " ")


def _of_letters(words: list[str]) -> str:
    """The words as one pattern that goes by first letters."""
    firsts = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in firsts)


# A word with a small letter that is a keyword.
_SMALL = rf"\b(?=[A-Za-z]{{{min(map(len, KEYWORDS))},{max(map(len, KEYWORDS))}}}+\b)(?=[A-Z]*+[a-z])(?i:{_of_letters(KEYWORDS)})\b"
# Ends of lines that white space does not hold; one of them may follow what goes from the end.
_LINE_ENDS = ["\u0085", "\u2028", "\u2029"]


def _where(text: Column, parts: list[str], change) -> Column:
    """The changed text where it holds one of the parts, without which nothing would change."""
    return let(text, lambda t: F.when(_holds(t, parts), change(t)).otherwise(t))


def _holds(text: Column, parts: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def _folded(text: Column) -> Column:
    """Nulls, signs and lists of a text whose literals are replaced."""
    signs, lists, rows = ["-?", "+?", "- ?", "+ ?"], ["(?", "( ?"], ["),", ") ,"]

    def change(text: Column) -> Column:
        text = _where(text, ["  "], lambda t: F.regexp_replace(t, " {2,}", " "))
        text = _where(text, ["NULL"], lambda t: F.regexp_replace(t, r"(?<![\w`.$@])(?<!\bIS )(?<!\bNOT )NULL(?![\w`$@])", "?"))
        text = _where(text, signs, lambda t: F.regexp_replace(t, rf"({_BEFORE_SIGN})( ?)[-+] ?\?", "$1$2?"))
        text = _where(text, lists, lambda t: F.regexp_replace(t, r"\bIN ?\( ?\?(?: ?, ?\?)* ?\)", "IN (...)"))
        text = _where(text, lists, lambda t: F.regexp_replace(t, r"\( ?\?(?: ?, ?\?)+ ?\)", "(...)"))
        several = r"(\(\.\.\.\)|\(\?\))(?: ?, ?(?:\(\.\.\.\)|\(\?\)))+"
        return _where(text, rows, lambda t: F.regexp_replace(t, several, "$1 /* , ... */"))

    return _where(text, ["  ", "NULL", *signs, *lists, *rows], change)


def digest_text(sql: Column | str) -> Column:
    """The normal form of a statement; null for null.

    Two statements that differ in literals only, in the length of IN lists or of
    lists of two rows and more, in comments, white space or the case of
    keywords, have the same. Names differ by case.
    """

    def digest(given: Column) -> Column:
        needs_tokens = _holds(given, ["`", "/*", "*/", "--", "#"]) | given.rlike(_SMALL)
        return F.when(needs_tokens, _of_tokens(given)).otherwise(_by_patterns(given))

    def ended(text: Column) -> Column:
        odd_end = reduce(Column.__or__, [text.endswith(c) for c in _LINE_ENDS])
        return F.when(odd_end, F.regexp_replace(text, r"[\s;]+$", "")).otherwise(F.rtrim(text, F.lit(" \t\n\x0b\f\r;")))

    return F.trim(let(_folded(let(S.column(sql), digest)), ended))
