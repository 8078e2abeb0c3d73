"""Scalar functions over columns; all stay in the JVM but for texts of doubles and values of INI and TOML texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The value (never SQL NULL) of an answer whose referent doesn't exist.
NONE = "NONE"


def exact_cents(x: Column) -> Column:
    """A double rounded to 2 places as an exact decimal, ready for an exact sum."""
    return F.round(x, 2).cast("decimal(18,2)")


def ratio_half_even(num: Column, den: Column, places: int, scale: int = 0) -> Column:
    """num / den as a decimal with ``places`` digits, ties to even; null if den is 0.

    Operands are narrowed first: the quotient then keeps 13 digits or more before it is
    rounded once.
    """
    n, d = num.cast(f"decimal(18,{scale})"), den.cast("decimal(12,0)")
    return F.when(d != 0, F.bround(n / d, places)).cast(f"decimal(20,{places})")


def answer(x: Column) -> Column:
    """The canonical text of an answer; null becomes NONE."""
    return F.coalesce(x.cast("string"), F.lit(NONE))


def hash_bucket(text: Column, first: int, digits: int, buckets: int) -> Column:
    """The number that ``digits`` hex digits of md5(text) from position ``first`` (1 up) make, modulo buckets."""
    part = F.conv(F.substring(F.md5(text), first, digits), 16, 10)
    return F.pmod(part.cast("decimal(20,0)"), F.lit(buckets)).cast("int")


def keep_row(text: Column, buckets: int = 64) -> Column:
    """Row sampling: the low bits of the first byte of md5(text) are zero."""
    return hash_bucket(text, 1, 2, buckets) == 0


def keep_key(key: Column, buckets: int = 64) -> Column:
    """Key sampling: the first 64 bits of md5(key) are divisible by buckets, so a key's whole history stays."""
    return hash_bucket(key, 1, 16, buckets) == 0


def held_back(key: Column, index: Column, every: int = 32) -> Column:
    """Late-row rule: the first 32 bits of md5("key:index") are divisible by ``every``."""
    return hash_bucket(F.concat_ws(":", key.cast("string"), index.cast("string")), 1, 8, every) == 0


def value_hash(x: Column) -> Column:
    """16 hex digits of a value's sha1."""
    return F.substring(F.sha1(x.cast("string")), 1, 16)


def fingerprint(items: Column) -> Column:
    """16 hex digits over an ordered array of hashes; null counts as empty."""
    joined = F.array_join(items, "\u001e", "")
    return F.substring(F.sha1(joined), 1, 16)


def state_of(pos: Column, h: Column) -> Column:
    """Aggregate: the fingerprint of the hashes h in the order of pos."""
    ordered = F.sort_array(F.collect_list(F.struct(pos.alias("p"), h.alias("h"))))
    return fingerprint(F.transform(ordered, lambda x: x["h"]))


def series_pattern(path: Column) -> Column:
    """A path with every run of digits as #: the series that it belongs to."""
    return F.regexp_replace(path, r"\d+", "#")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normal_path(path: Column) -> Column:
    """Quotes, blanks and leading ./ taken off."""
    bare = F.trim(F.regexp_replace(F.trim(path), r"^['\"`]+|['\"`]+$", ""))
    return F.regexp_replace(bare, r"^(\./)+", "")


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression for a whole path; **/ also matches no folder."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_pattern(glob: Column) -> Column:
    """The same for a column of patterns."""
    lone = F.regexp_replace(F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1"), r"\[(?![^\]]+\])", r"\\[")
    inside = F.replace(F.replace(lone, F.lit("**/"), F.lit("\u0001")), F.lit("*"), F.lit(".*"))
    body = F.replace(F.replace(inside, F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^"))
    return F.concat(F.lit("^"), F.replace(body, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("$"))


def glob_matches(path: Column, glob: str) -> Column:
    """Whether a path matches; a pattern without / is held against the basename alone."""
    return (path if "/" in glob else basename(path)).rlike(glob_regex(glob))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_bounds(month: Column) -> tuple[Column, Column]:
    """First instant of a month (text yyyy-MM) and of the next."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    return first.cast("timestamp_ntz"), F.add_months(first, 1).cast("timestamp_ntz")


def outside_month(ts: Column, month: Column) -> Column:
    low, high = month_bounds(month)
    return (ts < low) | (ts >= high)


def canonical_answer(given: Column, known: Column) -> Column:
    """A given answer in the form of the known one: quotes off; NONE in any case; a number at
    the known one's places; else the first whole number, if the known one is one; a list
    joined by ", "; else the text."""
    bare = F.trim(F.regexp_replace(F.trim(given), r"^[\"'`]+|[\"'`]+$", ""))
    number = F.regexp_replace(bare, ",", "")
    places = F.length(F.regexp_extract(known, r"\.(\d+)$", 1))
    fixed = F.try_to_number(number, F.lit("S9999999999999999D999999999999"))
    whole = F.regexp_extract(number, r"-?\d+", 0)
    listed = F.array_join(F.transform(F.split(bare, ","), lambda x: F.trim(x)), ", ")
    at = lambda k: F.bround(fixed.cast("decimal(30,12)"), k).cast(f"decimal(30,{k})").cast("string")
    decimal = F.coalesce(*[F.when(places == k, at(k)) for k in (1, 2, 3, 4, 5)])
    return (
        F.when(F.upper(bare) == NONE, F.lit(NONE))
        .when(known.rlike(r"^-?\d+\.\d+$"), F.coalesce(decimal, bare))
        .when(known.rlike(r"^-?\d+$"), F.when(whole != "", whole).otherwise(bare))
        .when(known.contains(","), listed)
        .otherwise(bare)
    )


def without_line_numbers(text: Column) -> Column:
    """Observation text with the numbers of lines taken out."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^(\S+?):\d+:", "$1:"), r"(?m)^\d+: ", "")


def unique_lines(text: Column) -> Column:
    """The lines of a text, sorted, each once."""
    return F.array_join(F.sort_array(F.array_distinct(F.split(text, "\n"))), "\n")


def visible_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and head out, block tags as line ends, blanks and empty lines folded."""
    s = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|head)\b.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)\b[^>]*>", "\n")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(c))
    s = F.regexp_replace(s, r"[ \t\r\x0b\x0c]+", " ")
    s = F.regexp_replace(s, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(s, r"^[ \n]+|[ \n]+$", "")


def rate_distance(a: Column, b: Column) -> Column:
    """How far apart two positive rates are: |ln(a / b)|."""
    return F.abs(F.ln(a / b))


def _float_text(x: pd.Series) -> pd.Series:
    return x.map("{:.10g}".format)


def float_text(x: Column) -> Column:
    """A double as text with ten significant digits, rounded from its exact value, and no zeros at the end; with an exponent
    below 1e-4 and from 1e10 on. A null stays null; the sign of -0 stays."""
    return F.when(x.isNotNull(), F.pandas_udf(_float_text, "string")(x))


#: Top-level folders that hold no source of a package.
NO_SOURCE = ("docs", "doc", "examples", "example", "benchmarks", "scripts", "tools")


def is_test(path: Column) -> Column:
    """Whether a path is a test file: in a folder of tests, or named like one."""
    return path.rlike(r"(^|/)tests?/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$")


def is_source(path: Column) -> Column:
    """Whether a path is a source file of the package: Python, no test, not in a folder beside the package."""
    return path.endswith(".py") & ~is_test(path) & ~F.split(path, "/")[0].isin(*NO_SOURCE)


PARSE_ERROR = "PARSE_ERROR"


def _ini(texts: pd.Series, section: pd.Series, key: pd.Series) -> pd.Series:
    import configparser

    def one(t, s, k):
        if t is None:
            return None
        p = configparser.ConfigParser(interpolation=None)
        try:
            p.read_string(t)
        except configparser.Error:
            return PARSE_ERROR
        return p.get(s, k, fallback=NONE)

    return pd.Series([one(*x) for x in zip(texts, section, key)], dtype=object)


def _toml(texts: pd.Series, path: pd.Series) -> pd.Series:
    import json
    import tomllib

    def one(t, path):
        if t is None:
            return None
        try:
            at = tomllib.loads(t)
        except tomllib.TOMLDecodeError:
            return PARSE_ERROR
        for k in path.split("."):
            if not isinstance(at, dict) or k not in at:
                return NONE
            at = at[k]
        return json.dumps(at, sort_keys=True, default=str)

    return pd.Series([one(*x) for x in zip(texts, path)], dtype=object)


def ini_value(text: Column, section: str, key: str) -> Column:
    """The value of a key in a section of an INI text; NONE if absent, PARSE_ERROR if the text is broken."""
    return F.pandas_udf(_ini, "string")(text, F.lit(section), F.lit(key))


def toml_value(text: Column, path: str) -> Column:
    """The value at a dotted path of a TOML text, as JSON; NONE if absent, PARSE_ERROR if the text is broken."""
    return F.pandas_udf(_toml, "string")(text, F.lit(path))


def question(period: Column, agg: Column, what: Column, name: Column) -> Column:
    """A fact as a question."""
    return F.concat(F.lit("In the data of "), period, F.lit(", what is the "), agg, F.lit(" of "), what, name, F.lit("?"))


def iso_text(ts: Column) -> Column:
    """A time as ISO 8601 text in seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def first_object(text: Column, key: str) -> Column:
    """The value of a key in the first JSON object of a text (an object without nested ones); NONE if there is none."""
    found = F.regexp_extract(text, r"\{[^{}]*\}", 0)
    return F.coalesce(F.get_json_object(found, f"$.{key}"), F.lit(NONE))


def sorted_json(text: Column) -> Column:
    """A flat JSON object with its keys in order; null if it is none."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.when(entries.isNotNull(), F.to_json(F.map_from_entries(F.array_sort(entries))))
