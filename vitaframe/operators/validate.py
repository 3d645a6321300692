"""Check profile JSON against the versioned schema, with the errors listed per row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions.extract import no_strings
from vitaframe.functions.skillwords import SKILL_CATEGORIES
from vitaframe.functions.text import let
from vitaframe.plans.profile import SCHEMA_VERSION

# ------------------------------------------------------------------ the rule table


@dataclass(frozen=True)
class Leaf:
    """A scalar field: its kind, an optional longest length and an optional format check."""

    kind: str = "string"
    longest: int | None = None
    check: str | None = None
    required: bool = False
    nullable: bool = True


@dataclass(frozen=True)
class Strings:
    """A list of strings."""

    nullable: bool = True
    required: bool = False


@dataclass(frozen=True)
class Model:
    """An object with named fields."""

    fields: dict = field(default_factory=dict)
    required: bool = False
    nullable: bool = True


@dataclass(frozen=True)
class Models:
    """A list of objects."""

    item: Model = field(default_factory=Model)
    required: bool = False
    nullable: bool = False


def _text(longest: int | None = None, check: str | None = None, **kw) -> Leaf:
    return Leaf("string", longest, check, **kw)


# Lengths, required fields and types of schema version 1.0.0, in field order.
_DATES = Model({
    "start_date": Leaf("date_or_text"), "end_date": Leaf("date_or_text"),
    "is_current": Leaf("bool", nullable=False), "raw_date_text": _text(200),
})
PROFILE_RULES = Model({
    "schema_version": _text(check="semver", nullable=False),
    "generated_at": Leaf("datetime", nullable=False),
    "extraction_method": _text(required=True, nullable=False),
    "source_file": _text(required=True, nullable=False),
    "contact": Model({
        "full_name": _text(200), "email": _text(254, "email"), "phone": _text(50, "phone"),
        "location": _text(200), "website": _text(500), "linkedin": _text(500), "github": _text(500),
        "address": _text(500), "social_profiles": Leaf("string_map"),
    }),
    "summary": Model({"text": _text(2000), "objective": _text(1000), "keywords": Strings()}),
    "experience": Models(Model({
        "company": _text(200), "position": _text(200), "location": _text(200), "dates": _DATES,
        "description": _text(5000), "responsibilities": Strings(), "technologies": Strings(),
        "confidence_score": Leaf("float"), "warnings": Strings(),
    })),
    "education": Models(Model({
        "institution": _text(200), "degree": _text(200), "field_of_study": _text(200), "location": _text(200),
        "dates": _DATES, "gpa": _text(20), "honors": Strings(), "relevant_coursework": Strings(),
        "confidence_score": Leaf("float"), "warnings": Strings(),
    })),
    "skills": Models(Model({
        "name": _text(100, required=True, nullable=False), "category": _text(check="category"),
        "proficiency_level": _text(50), "years_experience": Leaf("int"), "canonical_name": _text(100),
        "aliases": Strings(), "context": _text(500), "confidence_score": Leaf("float"),
    })),
    "projects": Models(Model({
        "name": _text(200, required=True, nullable=False), "description": _text(2000), "url": _text(500),
        "dates": _DATES, "technologies": Strings(), "role": _text(100), "team_size": Leaf("int"),
        "confidence_score": Leaf("float"),
    })),
    "achievements": Models(Model({
        "title": _text(200, required=True, nullable=False), "organization": _text(200),
        "date_received": Leaf("date_or_text"), "description": _text(1000), "type": _text(50),
        "expiration_date": Leaf("date_or_text"), "credential_id": _text(100), "verification_url": _text(500),
    })),
    "additional_sections": Leaf("object"),
    "metadata": Model({
        "extractor_version": _text(required=True, nullable=False),
        "extraction_timestamp": Leaf("datetime", required=True, nullable=False),
        "processing_time_ms": Leaf("int"), "confidence_score": Leaf("float", nullable=False),
        "source_file_hash": _text(), "file_size_bytes": Leaf("int"), "file_type": _text(),
        "sections_detected": Strings(), "language_detected": _text(10), "character_count": Leaf("int"),
        "structure_score": Leaf("float"), "completeness_score": Leaf("float"),
    }, required=True, nullable=False),
    "warnings": Strings(nullable=False),
    "errors": Strings(nullable=False),
})

CONTACT_FIELDS = tuple(PROFILE_RULES.fields["contact"].fields)
# Keys that no profile may hold.
PROHIBITED_KEYS = ("age", "gender", "race", "nationality", "marital_status")

# Error texts.
MESSAGES = {
    "string": "Input should be a valid string",
    "float": "Input should be a valid number",
    "int": "Input should be a valid integer",
    "bool": "Input should be a valid boolean",
    "datetime": "Input should be a valid datetime",
    "date_or_text": "Input should be a valid date or string",
    "object": "Input should be a valid dictionary",
    "string_map": "Input should be a valid dictionary",
    "list": "Input should be a valid list",
    "missing": "Field required",
    "email": "Value error, Invalid email format",
    "phone": "Value error, Invalid phone format",
    "semver": "Value error, Schema version must follow semantic versioning (x.y.z)",
    "category": "Input should be "
    + ", ".join(f"'{c}'" for c in SKILL_CATEGORIES[:-1])
    + f" or '{SKILL_CATEGORIES[-1]}'",
}


# ------------------------------------------------------------------ formats


# As SQL with a place for the text, so that the compiled rule table can use them too.
EMAIL_TEST = "rlike({}, r'^[^@]+@[^@]+\\.[^@]+$')"
PHONE_TEST = "rlike(regexp_replace({}, r'(?U)[\\s\\-()+.]', ''), r'(?U)^\\d{{7,15}}$')"
SEMVER_TEST = "rlike({}, r'(?U)^\\d+\\.\\d+\\.\\d+$')"


def is_email(column: str) -> Column:
    return F.expr(EMAIL_TEST.format(column))


def is_phone(column: str) -> Column:
    """Seven to fifteen digits once blanks and ``- ( ) + .`` are gone."""
    return F.expr(PHONE_TEST.format(column))


def is_semver(column: str) -> Column:
    return F.expr(SEMVER_TEST.format(column))


def _part(version: Column, i: int) -> Column:
    return F.get(F.split(version, r"\."), F.lit(i)).try_cast("int")


def is_compatible(version: Column, current: str = SCHEMA_VERSION) -> Column:
    """Same major and no newer minor; anything malformed is not compatible."""
    major, minor = (int(x) for x in current.split(".")[:2])
    numeric = version.rlike(r"^[+-]?\d+(\.[+-]?\d+)+$")
    return F.coalesce(numeric & (_part(version, 0) == major) & (_part(version, 1) <= minor), F.lit(False))


def migrated_version(version: Column, target: str = SCHEMA_VERSION) -> tuple[Column, Column]:
    """(version after migration, error): missing is stamped, compatible is rewritten."""
    missing = F.coalesce(version == "", F.lit(True))
    fits = missing | (version == target) | is_compatible(version, target)
    error = F.when(
        ~fits, F.concat(F.lit("Cannot migrate from schema version "), version, F.lit(f" to {target}"))
    )
    return F.when(fits, F.lit(target)).otherwise(version), error


# ------------------------------------------------------------------ rules to columns
#
# The rule table compiles to one SQL expression text: some 75 fields would otherwise mean
# thousands of Python-side column calls, which take longer than the planning.


def _is_number(kind: str) -> str:
    return f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Names:
    """Fresh lambda variable names."""

    def __init__(self):
        self.count = 0

    def __call__(self, stem: str) -> str:
        self.count += 1
        return f"{stem}{self.count}"


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _message_sql(path: str, text: str) -> str:
    return f"concat('Field \\'', {path}, '\\': ', {_quoted(text)})"


def _cases(path: str, *pairs: tuple[str, str]) -> str:
    """Array with the message of the first condition that holds, else empty."""
    whens = " ".join(f"WHEN {cond} THEN array({_message_sql(path, text)})" for cond, text in pairs)
    return f"CASE {whens} ELSE cast(array() AS array<string>) END"


def _leaf_sql(v: str, rule: Leaf, path: str, names: _Names) -> str:
    """Errors of a present, non-null scalar ``v``."""
    kind, text = names("kind"), names("text")
    pairs: list[tuple[str, str]]
    if rule.kind == "string":
        if rule.check == "category":
            allowed = ", ".join(_quoted(c) for c in SKILL_CATEGORIES)
            pairs = [(f"{kind} <> 'STRING' OR {text} NOT IN ({allowed})", MESSAGES["category"])]
        else:
            pairs = [(f"{kind} <> 'STRING'", MESSAGES["string"])]
            if rule.longest is not None:
                pairs.append((f"length({text}) > {rule.longest}", f"String should have at most {rule.longest} characters"))
            test = {"email": EMAIL_TEST, "phone": PHONE_TEST}.get(rule.check)
            if test:
                pairs.append((f"{text} <> '' AND NOT ({test.format(text)})", MESSAGES[rule.check]))
            if rule.check == "semver":
                pairs.append((f"NOT ({SEMVER_TEST.format(text)})", MESSAGES["semver"]))
    else:
        number = f"try_cast({text} AS double)"
        numeric = f"({_is_number(kind)} OR ({kind} = 'STRING' AND {number} IS NOT NULL))"
        spelled = "'true', 'false', 'yes', 'no', 'on', 'off', 't', 'f', 'y', 'n', '1', '0'"
        fine = {
            "float": f"{numeric} OR {kind} = 'BOOLEAN'",
            "int": f"({numeric} AND {number} = floor({number})) OR {kind} = 'BOOLEAN'",
            "bool": f"{kind} = 'BOOLEAN' OR ({kind} = 'STRING' AND lower({text}) IN ({spelled}))"
            f" OR ({_is_number(kind)} AND {text} IN ('0', '1'))",
            "datetime": f"{_is_number(kind)} OR ({kind} = 'STRING' AND try_cast({text} AS timestamp) IS NOT NULL)",
            "date_or_text": f"{kind} = 'STRING'",
            "object": f"{kind} LIKE 'OBJECT%'",
        }[rule.kind]
        pairs = [(f"NOT coalesce({fine}, false)", MESSAGES[rule.kind])]
    body = _cases(path, *pairs)
    inner = _bind(f"try_variant_get({v}, '$', 'string')", text, body)
    return _bind(f"schema_of_variant({v})", kind, inner)


def _not_text(v: str) -> str:
    return f"coalesce(schema_of_variant({v}) <> 'STRING', true)"


def _value_sql(v: str, rule, path: str, names: _Names) -> str:
    """Errors of a present, non-null value ``v`` as an array."""
    if isinstance(rule, Leaf) and rule.kind != "string_map":
        return _leaf_sql(v, rule, path, names)
    seen = names("seen")
    if isinstance(rule, Leaf):
        entry = names("entry")
        bad = f"filter(map_entries({seen}), {entry} -> {_not_text(entry + '.value')})"
        where = f"concat({path}, ' -> ', {entry}.key)"
        listed = f"transform({bad}, {entry} -> {_message_sql(where, MESSAGES['string'])})"
        source, wrong = f"try_variant_get({v}, '$', 'map<string,variant>')", MESSAGES["object"]
    elif isinstance(rule, Strings):
        item, at = names("item"), names("at")
        where = f"concat({path}, ' -> ', cast({at} AS string))"
        message = _message_sql(where, MESSAGES["string"])
        listed = f"array_compact(transform({seen}, ({item}, {at}) -> CASE WHEN {_not_text(item)} THEN {message} END))"
        source, wrong = f"try_variant_get({v}, '$', 'array<variant>')", MESSAGES["list"]
    elif isinstance(rule, Model):
        listed = _model_sql(v, rule, path, names)
        source, wrong = f"try_variant_get({v}, '$', 'map<string,variant>')", MESSAGES["object"]
    elif isinstance(rule, Models):
        item, at, where = names("item"), names("at"), names("where")
        is_object = f"try_variant_get({item}, '$', 'map<string,variant>') IS NOT NULL"
        wrong_item = f"array({_message_sql(where, MESSAGES['object'])})"
        checked = f"CASE WHEN {is_object} THEN {_model_sql(item, rule.item, where, names)} ELSE {wrong_item} END"
        per_item = _bind(f"concat({path}, ' -> ', cast({at} AS string))", where, checked)
        listed = f"flatten(transform({seen}, ({item}, {at}) -> {per_item}))"
        source, wrong = f"try_variant_get({v}, '$', 'array<variant>')", MESSAGES["list"]
    else:
        raise TypeError(rule)
    body = f"CASE WHEN {seen} IS NULL THEN array({_message_sql(path, wrong)}) ELSE {listed} END"
    return _bind(source, seen, body)


def _null_message(rule) -> str:
    if isinstance(rule, Leaf):
        return MESSAGES[rule.kind]
    return MESSAGES["object"] if isinstance(rule, Model) else MESSAGES["list"]


def _field_sql(parent: str, name: str, rule, prefix: str | None, names: _Names) -> str:
    path = _quoted(name) if prefix is None else f"concat({prefix}, {_quoted(' -> ' + name)})"
    none = "cast(array() AS array<string>)"
    absent = f"array({_message_sql(path, MESSAGES['missing'])})" if rule.required else none
    null = none if rule.nullable else f"array({_message_sql(path, _null_message(rule))})"
    v = names("v")
    body = (
        f"CASE WHEN {v} IS NULL THEN {absent} WHEN is_variant_null({v}) THEN {null} "
        f"ELSE {_value_sql(v, rule, path, names)} END"
    )
    return _bind(f"try_variant_get({parent}, '$.{name}', 'variant')", v, body)


def _model_sql(v: str, model: Model, prefix: str | None, names: _Names) -> str:
    return "flatten(array(" + ", ".join(_field_sql(v, n, r, prefix, names) for n, r in model.fields.items()) + "))"


def model_errors(variant_column: str, model: Model = PROFILE_RULES) -> Column:
    """Errors of all fields of a variant object column, in field order."""
    return F.expr(_model_sql(variant_column, model, None, _Names()))


# ------------------------------------------------------------------ rules for typed profiles
#
# A struct column has its types already; what is left to check are required fields, lengths, formats
# and nulls in lists. A null field counts as absent, as it is when the profile is written as JSON.


def _typed_leaf_sql(v: str, rule: Leaf, path: str) -> str:
    """Errors of a scalar column that is not null."""
    pairs: list[tuple[str, str]] = []
    if rule.kind == "object":
        pairs = [(f"NOT coalesce(schema_of_variant(try_parse_json({v})) LIKE 'OBJECT%', false)", MESSAGES["object"])]
    elif rule.kind == "string" and rule.check == "category":
        pairs = [(f"{v} NOT IN ({', '.join(_quoted(c) for c in SKILL_CATEGORIES)})", MESSAGES["category"])]
    elif rule.kind == "string":
        if rule.longest is not None:
            pairs.append((f"length({v}) > {rule.longest}", f"String should have at most {rule.longest} characters"))
        test = {"email": EMAIL_TEST, "phone": PHONE_TEST}.get(rule.check)
        if test:
            pairs.append((f"{v} <> '' AND NOT ({test.format(v)})", MESSAGES[rule.check]))
        if rule.check == "semver":
            pairs.append((f"NOT ({SEMVER_TEST.format(v)})", MESSAGES["semver"]))
    return _cases(path, *pairs) if pairs else ""


def _typed_value_sql(v: str, rule, path: str, names: _Names) -> str:
    """Errors of a column that is not null, as an array; empty text where nothing can be wrong."""
    if isinstance(rule, Leaf) and rule.kind == "string_map":
        entry = names("entry")
        where = f"concat({path}, ' -> ', {entry}.key)"
        return f"transform(filter(map_entries({v}), {entry} -> {entry}.value IS NULL), {entry} -> {_message_sql(where, MESSAGES['string'])})"
    if isinstance(rule, Leaf):
        return _typed_leaf_sql(v, rule, path)
    if isinstance(rule, Strings):
        item, at = names("item"), names("at")
        where = f"concat({path}, ' -> ', cast({at} AS string))"
        return f"array_compact(transform({v}, ({item}, {at}) -> CASE WHEN {item} IS NULL THEN {_message_sql(where, MESSAGES['string'])} END))"
    if isinstance(rule, Model):
        return _typed_model_sql(v, rule, path, names)
    item, at, where = names("item"), names("at"), names("where")
    checked = f"CASE WHEN {item} IS NULL THEN array({_message_sql(where, MESSAGES['object'])}) ELSE {_typed_model_sql(item, rule.item, where, names)} END"
    per_item = _bind(f"concat({path}, ' -> ', cast({at} AS string))", where, checked)
    return f"flatten(transform({v}, ({item}, {at}) -> {per_item}))"


def _typed_field_sql(parent: str, name: str, rule, prefix: str | None, names: _Names) -> str:
    path = _quoted(name) if prefix is None else f"concat({prefix}, {_quoted(' -> ' + name)})"
    v = f"{parent}.{name}"
    none = "cast(array() AS array<string>)"
    absent = f"array({_message_sql(path, MESSAGES['missing'])})" if rule.required else none
    found = _typed_value_sql(v, rule, path, names)
    if not found and not rule.required:
        return ""
    return f"CASE WHEN {v} IS NULL THEN {absent} ELSE {found or none} END"


def _typed_model_sql(v: str, model: Model, prefix: str | None, names: _Names) -> str:
    parts = [sql for n, r in model.fields.items() if (sql := _typed_field_sql(v, n, r, prefix, names))]
    return "concat(" + ", ".join(parts) + ")" if parts else "cast(array() AS array<string>)"


def typed_errors(profile: str, model: Model = PROFILE_RULES) -> Column:
    """Errors of all fields of a profile struct column, in field order."""
    return F.expr(_typed_model_sql(profile, model, None, _Names()))


# ------------------------------------------------------------------ prohibited keys


def _candidate(json: Column) -> Column:
    """Cheap test that spares most rows the walk: is such a key spelled anywhere?"""
    keys = "|".join(PROHIBITED_KEYS)
    return json.rlike(rf'(?i)"(?:{keys})"\s*:') | F.contains(json, F.lit("\\u"))


def prohibited_in_row(json: Column, root: str = "additional_sections") -> Column:
    """Paths of prohibited keys in nested objects, as an array; lists are not entered.

    A fold opens one level of objects per step. The number of braces bounds the depth, so
    no nesting is too deep; once nothing is left to open the remaining steps are free.
    """
    entry = "struct<p:string,k:string,v:variant>"
    state = f"struct<open:array<{entry}>,hits:array<string>>"

    def open_all(entries: Column) -> Column:
        children = F.transform(
            entries,
            lambda e: F.transform(
                F.coalesce(
                    F.map_entries(F.try_variant_get(e["v"], "$", "map<string,variant>")),
                    F.array().cast("array<struct<key:string,value:variant>>"),
                ),
                lambda kv: F.struct(
                    F.concat(e["p"], F.lit("."), kv["key"]).alias("p"), kv["key"].alias("k"), kv["value"].alias("v")
                ),
            ),
        )
        return F.flatten(children)

    def step(acc: Column, _: Column) -> Column:
        opened = let(
            open_all(acc["open"]),
            lambda es: F.struct(
                es.alias("open"),
                F.concat(
                    acc["hits"],
                    F.transform(F.filter(es, lambda e: F.lower(e["k"]).isin(*PROHIBITED_KEYS)), lambda e: e["p"]),
                ).alias("hits"),
            ),
        )
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(opened).cast(state)

    def walk(v: Column) -> Column:
        start = F.struct(
            F.array(F.struct(F.lit(root).alias("p"), F.lit("").alias("k"), v.alias("v"))).alias("open"),
            no_strings().alias("hits"),
        ).cast(state)
        depth = F.length(json) - F.length(F.replace(json, F.lit("{"), F.lit("")))
        steps = F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))
        return F.aggregate(steps, start, step, lambda acc: acc["hits"])

    return F.when(_candidate(json), let(F.try_parse_json(json), walk)).otherwise(no_strings())


def prohibited_paths(df: DataFrame, json: str, key: str, root: str = "additional_sections") -> DataFrame:
    """``(key, path)`` of every prohibited key in a JSON column; no shuffle."""
    return df.select(key, F.explode(prohibited_in_row(F.col(json), root)).alias("path"))


def disallowed_contact_keys(contact_json: Column) -> Column:
    """Contact keys outside the allow-list."""
    keys = F.coalesce(F.json_object_keys(contact_json), no_strings())
    return F.array_except(keys, F.array(*[F.lit(f) for f in CONTACT_FIELDS]))


# ------------------------------------------------------------------ reports


_BODY = Model({n: r for n, r in PROFILE_RULES.fields.items() if n != "schema_version"})
_REQUIRED = [n for n, r in PROFILE_RULES.fields.items() if r.required]
#: Errors of a whole top-level field, which a lenient check may drop.
_TOP = r"^Field '([a-z_]+)': "


def _prohibited(extra: Column) -> Column:
    return F.transform(
        F.coalesce(prohibited_in_row(extra), no_strings()),
        lambda p: F.concat(F.lit("Field '': Value error, Prohibited derived PII field detected: "), p),
    )


def _report(staged: DataFrame, strict: bool) -> DataFrame:
    """Errors, warnings and verdict from ``_parsed, _version, _fields`` (errors but the version's).

    ``_dropped`` are the top-level fields that a lenient check leaves out of a valid profile.
    """
    missing = F.coalesce(F.col("_version") == "", F.lit(True))
    same = F.col("_version") == SCHEMA_VERSION
    compatible = is_compatible(F.col("_version"))
    refused = ~missing & ~same & ~compatible
    # A missing or compatible version is rewritten before the check, so it cannot fail.
    version_errors = F.when(
        refused & ~is_semver("_version"), F.array(F.lit(f"Field 'schema_version': {MESSAGES['semver']}"))
    ).otherwise(no_strings())
    staged = staged.withColumns(
        {
            "_fields": F.when(F.col("_parsed"), F.concat(version_errors, "_fields")).otherwise(no_strings()),
            "_refused": F.when(
                refused,
                F.concat(F.lit("Incompatible schema version: "), F.col("_version"), F.lit(f" (current: {SCHEMA_VERSION})")),
            ),
            "_notes": F.array_compact(
                F.array(
                    F.when(missing & F.col("_parsed"), f"No schema version found, assuming {SCHEMA_VERSION}"),
                    F.when(
                        ~missing & ~same & compatible,
                        F.concat(F.lit("Migrated schema from "), F.col("_version"), F.lit(f" to {SCHEMA_VERSION}")),
                    ),
                )
            ),
        }
    )
    unreadable = F.array(F.lit("Invalid JSON"))
    dropped = no_strings()
    if strict:
        errors = (
            F.when(~F.col("_parsed"), unreadable)
            .when(F.col("_refused").isNotNull(), F.array("_refused"))
            .otherwise(F.col("_fields"))
        )
        warnings = F.col("_notes")
    else:
        keeps_failing = F.exists(
            F.col("_fields"),
            lambda e: ~e.rlike(_TOP) | e.rlike("^Field '(?:" + "|".join(_REQUIRED) + ")': "),
        )
        failing = F.col("_parsed") & keeps_failing
        moved = F.concat(
            F.transform(F.col("_fields"), lambda e: F.concat(F.lit("Removed invalid field: "), e)),
        )
        version_note = F.when(F.col("_refused").isNotNull(), F.array("_refused")).otherwise(no_strings())
        errors = (
            F.when(~F.col("_parsed"), unreadable)
            .when(failing, F.concat(version_note, F.col("_fields"), F.array(F.lit("Failed to clean invalid fields"))))
            .otherwise(no_strings())
        )
        warnings = F.when(failing | ~F.col("_parsed"), F.col("_notes")).otherwise(
            F.concat(F.col("_notes"), version_note, moved)
        )
        dropped = F.transform(F.col("_fields"), lambda e: F.regexp_extract(e, _TOP, 1))
    staged = staged.withColumns({"errors": errors, "warnings": warnings, "_dropped": dropped})
    valid = F.size("errors") == 0
    return staged.withColumns({"is_valid": valid, "profile_valid": valid, "schema_version": F.when(valid, SCHEMA_VERSION)})


_WORKING = ("_v", "_version", "_parsed", "_fields", "_refused", "_notes", "_dropped")


def _of_json(df: DataFrame, json: str, strict: bool) -> DataFrame:
    v = F.col("_v")
    staged = df.withColumn("_v", F.try_parse_json(json)).withColumn("_version", F.try_variant_get(v, "$.schema_version", "string"))
    parsed = v.isNotNull() & F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    extra = F.to_json(F.try_variant_get(v, "$.additional_sections", "variant"))
    staged = staged.withColumns({"_parsed": parsed, "_fields": F.concat(model_errors("_v", _BODY), _prohibited(extra))})
    return _report(staged, strict)


def validate(df: DataFrame, json: str, strict: bool = True) -> DataFrame:
    """Add ``is_valid, errors, warnings, profile_valid, schema_version`` for a JSON column.

    Strict: an incompatible version is the only error reported. Lenient: invalid top-level
    fields are dropped and their errors become warnings; a broken required field or an error
    further inside keeps the profile invalid.
    """
    return _of_json(df, json, strict).drop(*_WORKING)


def clean(df: DataFrame, json: str, strict: bool = False) -> DataFrame:
    """``validate`` with ``cleaned``, the profile that passed, as JSON; null where none did.

    It has the known fields that were there and were right, nulls and empty lists as they came, and the current
    schema version. What a lenient check dropped is named in ``warnings``. ``sources.tables.profiles_from_json`` reads it.
    """
    staged = _of_json(df, json, strict)
    fields = F.try_variant_get("_v", "$", "map<string,variant>")
    known = F.array(*[F.lit(n) for n in _BODY.fields])
    kept = F.map_filter(fields, lambda name, _: F.array_contains(known, name) & ~F.array_contains(F.col("_dropped"), name))
    version = F.create_map(F.lit("schema_version"), F.try_parse_json(F.lit(f'"{SCHEMA_VERSION}"')))
    return staged.withColumn("cleaned", F.when(F.col("is_valid"), F.to_json(F.map_concat(version, kept)))).drop(*_WORKING)


def _of_struct(df: DataFrame, profile: str, strict: bool) -> DataFrame:
    staged = df.withColumns(
        {
            "_version": F.col(f"{profile}.schema_version"),
            "_parsed": F.col(profile).isNotNull(),
            "_fields": F.concat(typed_errors(profile, _BODY), _prohibited(F.col(f"{profile}.additional_sections"))),
        }
    )
    return _report(staged, strict)


def validate_profiles(df: DataFrame, profile: str = "profile", strict: bool = True) -> DataFrame:
    """``validate`` for a typed profile column, without a way through JSON; a null profile is no profile ("Invalid JSON")."""
    return _of_struct(df, profile, strict).drop(*_WORKING)


def clean_profiles(df: DataFrame, profile: str = "profile", strict: bool = False) -> DataFrame:
    """``validate_profiles`` with the profile column cleaned and migrated: failing top-level fields are null, the version
    is the current one, and profiles that did not pass are null."""
    staged = _of_struct(df, profile, strict)
    kinds = {f.name: f.dataType for f in df.schema[profile].dataType.fields}

    def kept(name: str) -> Column:
        own = F.col(f"{profile}.{name}")
        if name == "schema_version":
            return F.lit(SCHEMA_VERSION)
        return F.when(~F.array_contains("_dropped", F.lit(name)), own).cast(kinds[name])

    rebuilt = F.struct(*[kept(name).alias(name) for name in kinds])
    return staged.withColumn(profile, F.when(F.col("is_valid"), rebuilt)).drop(*_WORKING)


def error_counts(report: DataFrame) -> DataFrame:
    """How often each error occurs; entry numbers are folded to ``*``.

    ``explode_outer`` on purpose: for ``explode`` the optimizer adds a non-empty filter on the
    list and pushes it to the scan, where all rules would be worked out a second time.
    """
    folded = F.regexp_replace("error", r"-> \d+", "-> *")
    return (
        report.select(F.explode_outer("errors").alias("error"))
        .where(F.col("error").isNotNull())
        .groupBy(folded.alias("error"))
        .agg(F.count("*").alias("profiles"))
    )


def is_valid_profile(df: DataFrame, json: str) -> DataFrame:
    """Only the verdict, leniently checked."""
    return validate(df, json, strict=False).drop("errors", "warnings", "profile_valid", "schema_version")


def profile_errors(df: DataFrame, json: str) -> DataFrame:
    """Only the strict error list."""
    return validate(df, json, strict=True).drop("is_valid", "warnings", "profile_valid", "schema_version")


