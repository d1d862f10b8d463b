"""Text column expressions: cell normalisation, header encoding, n-grams,
word tokens.  All are plain ``pyspark.sql.functions`` compositions, so they
run inside whole-stage codegen; ``sql_*`` twins render the same rule for
DuckDB so the oracle and the Spark job share one definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal tokens).
# Characters a cell may keep; everything else is dropped.
VALID_CHARS = (
    "!?*\\/+-:;'\"#~<>`%$&@€[]{}"
    "0123456789"
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    "abcdefghijklmnopqrstuvwxyz"
    "., "
)
# Special signs collapsed to '*' by the plain normalisation.
SPECIAL_SIGNS = ".!?*\\/+-:;'\"#~<>`%$&@€[]{}"
# Header code table: ASCII code i < 64 maps to U+0100 + i, i >= 64 to U+00C0 + (i - 64).
HEADER_CODE_LOW_BASE = 0x100
HEADER_CODE_HIGH_BASE = 0xC0
# Token filler for null / empty cells before lookup.
NULL_TOKEN = "_"
# Row linearisation: empty cell token and the maximum tokens per cell.
EMPTY_CELL_TOKEN = "-"
MAX_CELL_TOKENS = 30
# Prefixes of graph terms.
HEADER_PREFIX = "h#"
DATA_PREFIX = "d#"
# ---------------------------------------------------------------------------


def _char_class(chars: str, negate: bool = False) -> str:
    """A regex character class (Java and RE2 alike) holding ``chars``."""
    out = []
    for c in chars:
        out.append("\\" + c if c in "\\[]^-" else c)
    return "[" + ("^" if negate else "") + "".join(out) + "]"


INVALID_RE = _char_class(VALID_CHARS, negate=True)
SPECIAL_RE = _char_class(SPECIAL_SIGNS)
DIGIT_RE = "[0-9]"


def _header_code(ch: str) -> str:
    i = ord(ch)
    return chr(HEADER_CODE_LOW_BASE + i) if i < 64 else chr(HEADER_CODE_HIGH_BASE + i - 64)


# Characters that can reach the header encoder: the valid set (minus the
# euro sign, dropped first, see README) plus the underscore made from spaces.
_HEADER_ALPHABET = "".join(sorted(set(VALID_CHARS.replace("€", "").replace(" ", "") + "_")))
HEADER_FROM = _HEADER_ALPHABET
HEADER_TO = "".join(_header_code(c) for c in _HEADER_ALPHABET)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- C1 / C2 ---------------------------------------------------------------
def normalize_cell(c) -> Column:
    """Keep valid chars, space -> '_', special signs -> '*', digits -> '@', lower."""
    x = F.regexp_replace(_col(c), INVALID_RE, "")
    x = F.regexp_replace(x, " ", "_")
    x = F.regexp_replace(x, SPECIAL_RE, "*")
    x = F.regexp_replace(x, DIGIT_RE, "@")
    return F.lower(x)


def normalize_cell_wildcards(c) -> Column:
    """Keep valid chars, space -> '_', lower; signs and digits stay."""
    x = F.regexp_replace(_col(c), INVALID_RE, "")
    x = F.regexp_replace(x, " ", "_")
    return F.lower(x)


# --- C3 / C4 / C5 ----------------------------------------------------------
def encode_header(c, has_wildcards: bool = False) -> Column:
    """Normalise, then move every char to the disjoint header alphabet."""
    base = normalize_cell_wildcards(c) if has_wildcards else normalize_cell(c)
    base = F.regexp_replace(base, "€", "")
    return F.translate(base, HEADER_FROM, HEADER_TO)


def decode_header(c) -> Column:
    """C4: inverse of the header alphabet shift."""
    return F.translate(_col(c), HEADER_TO, HEADER_FROM)


def encode_data(c, has_wildcards: bool = False) -> Column:
    return normalize_cell_wildcards(c) if has_wildcards else normalize_cell(c)


def encode_prefixed_term(c) -> Column:
    """C5: 'h#x' -> wildcard header code of x, 'd#x' -> wildcard data code of x,
    other prefixes -> null (callers count and drop them)."""
    t = _col(c)
    rest = F.substr(t, F.lit(3))
    return (F.when(t.startswith(HEADER_PREFIX), encode_header(rest, True))
             .when(t.startswith(DATA_PREFIX), encode_data(rest, True)))


# --- B10 -------------------------------------------------------------------
def null_token(c) -> Column:
    """A null or empty cell becomes '_' before lookup."""
    v = _col(c)
    return F.when(v.isNull() | (v == ""), F.lit(NULL_TOKEN)).otherwise(v)


def cell_token(c) -> Column:
    """The lookup token of a cell: C1 over the B10-filled value."""
    return normalize_cell(null_token(c))


# --- C6 --------------------------------------------------------------------
def subword_ngrams(c, min_n: int = 3, max_n: int = 7) -> Column:
    """Character n-grams (min_n..max_n) of '<token>', in order of n then position."""
    w = F.concat(F.lit("<"), _col(c), F.lit(">"))
    ns = F.filter(F.sequence(F.lit(min_n), F.lit(max_n)), lambda n: n <= F.length(w))
    return F.flatten(F.transform(
        ns, lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1),
                                  lambda i: F.substring(w, i, n))))


def ngram_bucket(g, dim: int) -> Column:
    """Hash bucket of an n-gram: first 8 hex digits of md5, modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def ngram_sign(g) -> Column:
    """+1 when the 9th hex digit of md5 is >= 8, else -1."""
    return F.when(F.substring(F.md5(g), 9, 1) >= F.lit("8"), F.lit(1.0)).otherwise(F.lit(-1.0))


# --- L1 --------------------------------------------------------------------
def tokenize_cell(c, max_tokens: int = MAX_CELL_TOKENS) -> Column:
    """L1: lower-cased word tokens of a cell, at most ``max_tokens``; none -> ['-']."""
    toks = F.filter(F.split(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))), "[^a-z0-9]+"),
                    lambda t: t != "")
    toks = F.slice(toks, 1, max_tokens)
    return F.when(F.size(toks) == 0, F.array(F.lit(EMPTY_CELL_TOKEN))).otherwise(toks)


# ---------------------------------------------------------------------------
# DuckDB renderings of the same rules (used by the oracles).
def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_normalize_cell(x: str) -> str:
    e = f"regexp_replace({x}, {sql_str(INVALID_RE)}, '', 'g')"
    e = f"replace({e}, ' ', '_')"
    e = f"regexp_replace({e}, {sql_str(SPECIAL_RE)}, '*', 'g')"
    e = f"regexp_replace({e}, '[0-9]', '@', 'g')"
    return f"lower({e})"


def sql_normalize_cell_wildcards(x: str) -> str:
    e = f"regexp_replace({x}, {sql_str(INVALID_RE)}, '', 'g')"
    e = f"replace({e}, ' ', '_')"
    return f"lower({e})"


def sql_encode_header(x: str, has_wildcards: bool = False) -> str:
    base = sql_normalize_cell_wildcards(x) if has_wildcards else sql_normalize_cell(x)
    return f"translate(replace({base}, '€', ''), {sql_str(HEADER_FROM)}, {sql_str(HEADER_TO)})"


def sql_cell_token(x: str) -> str:
    return sql_normalize_cell(f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '_' ELSE {x} END)")


def sql_subword_ngrams(x: str, min_n: int = 3, max_n: int = 7) -> str:
    w = f"('<' || {x} || '>')"
    return (f"flatten(list_transform(list_filter(range({min_n}, {max_n + 1}), lambda n: n <= length({w})), "
            f"lambda n: list_transform(range(1, length({w}) - n + 2), lambda i: substring({w}, i, n))))")


def sql_ngram_bucket(g: str, dim: int) -> str:
    return f"CAST((('0x' || substr(md5({g}), 1, 8))::BIGINT % {dim}) AS INTEGER)"


def sql_ngram_sign(g: str) -> str:
    return f"(CASE WHEN substr(md5({g}), 9, 1) >= '8' THEN 1.0 ELSE -1.0 END)"


def sql_tokenize_cell(x: str, max_tokens: int = MAX_CELL_TOKENS) -> str:
    toks = (f"list_slice(list_filter(string_split_regex(lower(coalesce(CAST({x} AS VARCHAR), '')), "
            f"'[^a-z0-9]+'), lambda t: t <> ''), 1, {max_tokens})")
    return f"(CASE WHEN len({toks}) = 0 THEN ['-'] ELSE {toks} END)"
