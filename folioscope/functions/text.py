"""Scalar text rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
REPLACEMENT = "\ufffd"

# Table header labels and the keys they stand for.
HEADER_KEYS = {
    "date": "date",
    "transaction": "narration", "narration": "narration", "description": "narration", "particulars": "narration",
    "amount": "amount", "amount (inr)": "amount",
    "units": "units",
    "price": "price", "price per unit": "price", "price unit": "price", "nav price": "price",
    "balance": "balance", "balance (inr)": "balance", "closing balance": "balance",
    "withdrawal": "withdrawal", "debit": "withdrawal", "withdrawn": "withdrawal", "paid out": "withdrawal",
    "deposit": "deposit", "credit": "deposit", "paid in": "deposit",
    "chq": "chq_ref", "cheque": "chq_ref", "ref": "chq_ref", "reference": "chq_ref", "chq/ref": "chq_ref",
}
#: Keys that make a table a list of transactions.
TRANSACTION_KEYS = ("date", "narration", "amount", "units", "price", "balance", "withdrawal", "deposit", "chq_ref")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without any White_Space at either end."""
    return F.btrim(col(c), F.lit(WHITE))


def words(c: Column) -> Column:
    """Split at runs of White_Space, without empty parts."""
    return F.filter(F.split(c, f"[{WHITE}]+"), lambda w: w != "")


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def snake_name(label: Column) -> Column:
    """Lower case, letters, digits and plain blanks only, words joined by underscores."""
    return F.array_join(words(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N} ]", "")), "_")


def header_key(label: Column) -> Column:
    low = F.array_join(words(F.lower(label)), " ")
    known = F.create_map(*(F.lit(x) for kv in HEADER_KEYS.items() for x in kv))
    other = F.array_join(F.filter(F.split(low, r"[^\p{L}\p{N}]"), lambda w: w != ""), "_")
    return F.coalesce(F.try_element_at(known, low), other)


def field_type(sample: Column) -> Column:
    """'date', 'number' or 'string' of a sample value."""
    s = trim(sample)
    iso = s.rlike(r"^20[2-9]\d-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\z")
    us = s.rlike(r"^0*([1-9]|1[0-2])/0*([1-9]|[12]\d|3[01])/0*20[2-9]\d\z")
    amount = s.rlike(r"^\$[\p{N},]*\.?[\p{N},]*\z") & (F.length(s) > 1)
    percent = s.rlike(r"^[\p{N},]*\.?[\p{N},]*%\z") & (F.length(s) > 1)
    plain = (
        s.rlike(r"\p{N}")
        & (F.length(F.regexp_replace(s, r"\p{N}", "")) <= 3)
        & ~has_letter(s)
        & (F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))) <= 1)
        & (F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))) <= 1)
    )
    return (
        F.when((s == "") | (F.octet_length(s) > 100), "string").when(iso | us, "date").when(amount | percent | plain, "number").otherwise("string")
    )


def is_table_date(c: Column) -> Column:
    """A DD-MMM-YYYY cell."""
    return c.rlike(r"^\p{N}{1,2}-\p{L}{3}-\p{N}{4}\z")


def is_toc_entry(label: Column, value: Column) -> Column:
    """A bare page number beside a label that doesn't end with a colon."""
    return trim(value).rlike(r"^[0-9]{1,4}\z") & ~F.rtrim(label, F.lit(WHITE)).endswith(":")


def colon_label(text: Column) -> Column:
    return F.when(text.contains(":"), trim(F.substring_index(text, ":", 1)))


def colon_value(text: Column) -> Column:
    return F.when(text.contains(":"), trim(F.substr(text, F.instr(text, ":") + 1)))


def is_label(label: Column) -> Column:
    return (label != "") & (F.octet_length(label) <= 40) & has_letter(label)


def display_label(name: Column) -> Column:
    """Underscores to blanks, first letter of each word in upper case, the rest kept."""
    parts = F.split(F.replace(name, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def compact_line(line: Column) -> Column:
    """Leaders (runs of dots, underscores and middle dots of three bytes or more) become one blank."""
    return F.rtrim(F.regexp_replace(line, r" ?([._·]{3,}|·[._·]|[._]·)", " "), F.lit(WHITE))


def without_breaks(c: Column) -> Column:
    return F.translate(c, "|\n", "")


def token_estimate(c: Column) -> Column:
    cjk = F.length(F.regexp_replace(c, r"[\x{0000}-\x{2E80}]", ""))
    return F.floor((F.length(c) - cjk) / 4).cast("long") + F.floor(cjk / 2).cast("long")


def cost_cents(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6 * 100).cast("long")


def retry_backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(8000), (F.lit(500) * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(4)))).cast("int"))


def is_retryable(status: Column) -> Column:
    return status.isin(429, 500, 502, 503, 504)


# Words in an error message that tell its kind, in order of the check.
ERROR_WORDS = {
    "auth": ("401", "unauthorized", "auth"),
    "rate_limit": ("429", "rate limit", "too many requests"),
    "timeout": ("timeout", "timed out", "timedout"),
    "parse_error": ("expected value", "invalid type", "parse error", "expected"),
}


def error_kind(message: Column) -> Column:
    low = F.lower(message)
    out = None
    for kind, signs in ERROR_WORDS.items():
        hit = reduce(lambda a, b: a | b, [low.contains(s) for s in signs])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def is_layout_id(c: Column) -> Column:
    return c.rlike(r"^[0-9A-Fa-f]{64}\z")


def is_safe_path(c: Column) -> Column:
    """Not empty and without a '..' part."""
    return (trim(c) != "") & ~F.array_contains(F.split(c, r"[/\\]"), "..")


# ---------------------------------------------------------------- text quality


def is_garbage(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, r"\.{3,}|_{3,}|·{3,}", ""), rf"[{WHITE}#*|\-]", "")
    return (F.length(x) >= 50) & (F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) * 2 < F.length(x))


def dollars_as_blanks(c: Column) -> Column:
    n = F.length(c) - F.length(F.replace(c, F.lit("$"), F.lit("")))
    between = F.regexp_count(c, F.lit(r"(?<=[A-Za-z])\$(?=[A-Za-z])"))
    return (n > 10) & ((between > 20) | (between * 2 > n))


def is_cid_garbage(c: Column) -> Column:
    x = F.regexp_replace(c, f"[{WHITE}]", "")
    total = F.length(x)
    controls = F.length(F.regexp_replace(x, r"[^\x{80}-\x{9F}]", ""))
    high = F.length(F.regexp_replace(F.replace(x, F.lit("·"), F.lit("")), r"[^\x{A0}-\x{FF}]", ""))
    ascii_letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return is_garbage(c) | (
        (total >= 5)
        & (((controls >= 2) & (controls * 20 >= total)) | ((total >= 20) & (high * 5 >= total * 2) & (ascii_letters * 3 < total)))
    )


def replacement_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(REPLACEMENT), F.lit("")))


def replacement_run(c: Column) -> Column:
    """Longest run of replacement characters."""
    runs = F.filter(F.split(c, f"[^{REPLACEMENT}]+"), lambda r: r != "")
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def has_replacement_run(c: Column) -> Column:
    return (replacement_run(c) >= 2) | (replacement_count(c) >= 3)


def has_private_use_run(c: Column) -> Column:
    x = F.regexp_replace(c, f"[{WHITE}]", "")
    n = F.length(F.regexp_replace(x, PRIVATE_USE.replace("[", "[^", 1), ""))
    return c.rlike(PRIVATE_USE + "{3,}") | ((F.length(x) >= 5) & (n >= 2) & (n * 2 >= F.length(x)))


def has_control_token(c: Column) -> Column:
    def bad(w: Column) -> Column:
        n = F.length(F.regexp_replace(w, r"[^\x{80}-\x{9F}]", ""))
        return (F.length(w) >= 5) & (n >= 2) & (n * 20 >= F.length(w))

    return F.exists(words(c), bad)


def span_issue(text: Column) -> Column:
    """'strong', 'replacement' or null."""
    t = trim(text)
    strong = dollars_as_blanks(t) | has_private_use_run(t) | is_cid_garbage(t) | has_control_token(t)
    return F.when(t == "", None).when(strong, "strong").when(has_replacement_run(t), "replacement")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often they are read: the optimizer would write
    them out again at each place, but doesn't look through a generator."""
    made = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return made.select(*(F.col(c) for c in df.columns if c not in columns), *(F.col(f"_once.{n}") for n in columns))
