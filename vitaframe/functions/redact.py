"""Replace personal data in text and nested columns by stable hashed placeholders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaframe.functions.text import dialect, let

# What is looked for, as (label, pattern, ignore case), in the order applied.
PII_PATTERNS = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", True),
    "phone": (r"[\+]?[1-9]?[\d\s\-\(\)\.]{7,15}\d", False),
    "url": (r"https?://[^\s]+|www\.[^\s]+", True),
    "name": (r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", False),
    "address": (
        r"\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd)\b",
        True,
    ),
    "ssn": (r"\b\d{3}-?\d{2}-?\d{4}\b", False),
    "creditcard": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", False),
}
USER_PATH = r"[/\\](?:home|Users)[/\\]([^/\\]+)"

# Field names whose content is personal data.
PII_FIELD_NAMES = (
    "email", "mail", "e_mail", "email_address",
    "phone", "telephone", "mobile", "cell", "phone_number",
    "name", "full_name", "first_name", "last_name", "username",
    "address", "street", "home_address", "billing_address",
    "ssn", "social_security", "passport", "license",
    "password", "passwd", "secret", "key", "token",
    "ip", "ip_address", "ipv4", "ipv6",
)

NEED_DIGITS = ("phone", "address", "ssn", "creditcard")

SEQUENTIAL = tuple(PII_PATTERNS)
# Narrow patterns first, so that a phone match cannot swallow part of a card number.
SPECIFIC_FIRST = ("email", "url", "creditcard", "ssn", "address", "phone", "name")


def hashed(label: str | Column, value: Column) -> Column:
    """``label_[first 8 hex digits of sha256(value)]``."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(label, F.lit("_["), F.substring(F.sha2(value, 256), 1, 8), F.lit("]"))


def replace_hashed(text: Column, label: str, pattern: str) -> Column:
    """Replace each match of a Java regex by the hashed placeholder of the match.

    One regex pass splits the text; only texts that contain a match pay for the second
    pass that fetches the matches and weaves them back in.
    """

    def weave(parts: Column) -> Column:
        marks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: hashed(label, m))
        woven = F.zip_with(parts, marks, lambda part, mark: F.concat(part, F.coalesce(mark, F.lit(""))))
        return F.when(F.size(parts) == 1, text).otherwise(F.array_join(woven, ""))

    return let(F.split(text, pattern, -1), weave)


def redact_user_paths(text: Column, boundary: str = "unicode") -> Column:
    """``/home/jane/cv.pdf`` -> ``/home/user_[hash]/cv.pdf``: every copy of the name in the match."""
    pattern = dialect(USER_PATH, boundary, ignore_case=True)

    def mark(match: Column) -> Column:
        return let(
            F.regexp_extract(match, pattern, 1), lambda user: F.replace(match, user, hashed("user", user))
        )

    def weave(parts: Column) -> Column:
        marks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), mark)
        woven = F.zip_with(parts, marks, lambda part, m: F.concat(part, F.coalesce(m, F.lit(""))))
        return F.when(F.size(parts) == 1, text).otherwise(F.array_join(woven, ""))

    return let(F.split(text, pattern, -1), weave)


def redact_text(text: Column, order: Sequence[str] = SEQUENTIAL, boundary: str = "unicode") -> Column:
    """All pattern kinds in ``order``, then user names in file paths.

    Each kind works on the output of the one before, so the order is part of the result.
    Works on whole texts: the phone pattern may run across line ends.
    """

    def apply(current: Column, kinds: Sequence[str]) -> Column:
        if not kinds:
            return redact_user_paths(current, boundary)
        kind, rest = kinds[0], kinds[1:]
        pattern, ignore_case = PII_PATTERNS[kind]
        step = replace_hashed(current, kind, dialect(pattern, boundary, ignore_case))
        # Cheap tests for what every match must hold spare most texts the full pattern.
        if kind == "email":
            step = F.when(F.contains(current, F.lit("@")), step).otherwise(current)
        elif kind in NEED_DIGITS:
            step = F.when(current.rlike(dialect(r"\d", boundary)), step).otherwise(current)
        return let(step, lambda done: apply(done, rest))

    return let(text, lambda t: apply(t, tuple(order)))


def count_matches(text: Column, kind: str, boundary: str = "unicode") -> Column:
    pattern, ignore_case = PII_PATTERNS[kind]
    return F.regexp_count(text, F.lit(dialect(pattern, boundary, ignore_case))).cast("long")


# ------------------------------------------------------------ fields and structures


def is_pii_field(name: str, match: str = "substring") -> bool:
    """Does a column name denote personal data?

    ``substring`` looks for the listed names anywhere in ``name`` (so ``description``
    counts, it holds ``ip``); ``word`` compares whole ``_``-separated words.
    """
    lowered = name.lower()
    if match == "substring":
        return any(field in lowered for field in PII_FIELD_NAMES)
    if match == "word":
        words = lowered.split("_")
        joined = f"_{lowered}_"
        return any(f"_{field}_" in joined for field in PII_FIELD_NAMES) or any(
            word in PII_FIELD_NAMES for word in words
        )
    raise ValueError(f"match must be 'substring' or 'word', not {match!r}")


def is_pii_key(key: Column, match: str = "substring") -> Column:
    """The same test on a column of key names (map keys, key/value logs)."""
    names = "|".join(PII_FIELD_NAMES)
    return F.lower(key).rlike(names if match == "substring" else f"(^|_)({names})(_|$)")


# Which placeholder label a field name leads to, first hit wins.
FIELD_LABELS = (
    ("email", ("email", "mail")),
    ("phone", ("phone", "mobile")),
    ("name", ("name",)),
    ("address", ("address",)),
    ("secret", ("password", "secret")),
    ("ip", ("ip",)),
)


def field_label(name: str) -> str:
    lowered = name.lower()
    return next((label for label, parts in FIELD_LABELS if any(p in lowered for p in parts)), "pii")


def field_label_of(key: Column) -> Column:
    """Label per row, for columns of key names."""
    lowered = F.lower(key)
    out = None
    for label, parts in FIELD_LABELS:
        hit = lowered.rlike("|".join(parts))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("pii")


def _as_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    return value.cast("string")


def _falsy(value: Column, dtype: T.DataType) -> Column:
    """Null, empty, 0 and false."""
    falsy = value.isNull()
    if isinstance(dtype, T.StringType):
        falsy = falsy | (value == "")
    elif isinstance(dtype, T.NumericType):
        falsy = falsy | (value == 0)
    elif isinstance(dtype, T.BooleanType):
        falsy = falsy | ~value
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        falsy = falsy | (F.size(value) == 0)
    return falsy


def redact_field(value: Column, name: str, dtype: T.DataType) -> Column:
    """Placeholder for the whole value of a personal field; null, empty, 0 and false stay."""
    text = _as_text(value, dtype)
    return F.when(_falsy(value, dtype), text).otherwise(hashed(field_label(name), text))


def redact_value(
    value: Column, dtype: T.DataType, match: str = "substring", boundary: str = "unicode"
) -> Column:
    """Redact a nested value by walking its type: no rows are looked at to plan this.

    The key of a map entry decides first. As its placeholder is text, the values of every map with
    string keys come out as text (nested ones as JSON).
    """
    if isinstance(dtype, T.StringType):
        return redact_text(value, boundary=boundary)
    if isinstance(dtype, T.StructType):
        fields = [
            _redact_named(value[f.name], f.name, f.dataType, match, boundary).alias(f.name) for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: redact_value(item, dtype.elementType, match, boundary))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        vtype = dtype.valueType

        def entry(key: Column, item: Column) -> Column:
            text = _as_text(item, vtype)
            plain = _as_text(redact_value(item, vtype, match, boundary), vtype)
            masked = F.when(_falsy(item, vtype), text).otherwise(hashed(field_label_of(key), text))
            return F.when(is_pii_key(key, match), masked).otherwise(plain)

        return F.transform_values(value, entry)
    return value


def _redact_named(value: Column, name: str, dtype: T.DataType, match: str, boundary: str) -> Column:
    if is_pii_field(name, match):
        return redact_field(value, name, dtype)
    return redact_value(value, dtype, match, boundary)


def redact_frame(
    df: DataFrame, keep: Sequence[str] = (), match: str = "substring", boundary: str = "unicode"
) -> DataFrame:
    """Redact every column of a batch or streaming frame, but for the columns in ``keep``."""
    return df.select(
        *[
            F.col(f.name)
            if f.name in keep
            else _redact_named(F.col(f.name), f.name, f.dataType, match, boundary).alias(f.name)
            for f in df.schema.fields
        ]
    )


def redact_log_events(
    df: DataFrame, keep: Sequence[str] = (), match: str = "substring", boundary: str = "unicode"
) -> DataFrame:
    """Redact a log table or stream and mark each row for the audit trail."""
    return redact_frame(df, keep, match, boundary).withColumn("_pii_redacted", F.lit(True))
