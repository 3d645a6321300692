"""The versioned profile: target schema, construction from parser results, presentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions.dates import iso_date_or_text
from vitaframe.functions.extract import no_strings
from vitaframe.functions.files import type_of_name
from vitaframe.functions.text import basename, blank_to_null, let

SCHEMA_VERSION = "1.0.0"

_DATES = "struct<start_date:string,end_date:string,is_current:boolean,raw_date_text:string>"
PROFILE_FIELDS = {
    "schema_version": "string",
    "generated_at": "timestamp",
    "extraction_method": "string",
    "source_file": "string",
    "contact": (
        "struct<full_name:string,email:string,phone:string,location:string,website:string,linkedin:string,"
        "github:string,address:string,social_profiles:map<string,string>>"
    ),
    "summary": "struct<text:string,objective:string,keywords:array<string>>",
    "experience": (
        f"array<struct<company:string,position:string,location:string,dates:{_DATES},description:string,"
        "responsibilities:array<string>,technologies:array<string>,confidence_score:double,warnings:array<string>>>"
    ),
    "education": (
        f"array<struct<institution:string,degree:string,field_of_study:string,location:string,dates:{_DATES},"
        "gpa:string,honors:array<string>,relevant_coursework:array<string>,confidence_score:double,"
        "warnings:array<string>>>"
    ),
    "skills": (
        "array<struct<name:string,category:string,proficiency_level:string,years_experience:int,"
        "canonical_name:string,aliases:array<string>,context:string,confidence_score:double>>"
    ),
    "projects": (
        f"array<struct<name:string,description:string,url:string,dates:{_DATES},technologies:array<string>,"
        "role:string,team_size:int,confidence_score:double>>"
    ),
    "achievements": (
        "array<struct<title:string,organization:string,date_received:string,description:string,type:string,"
        "expiration_date:string,credential_id:string,verification_url:string>>"
    ),
    "additional_sections": "string",
    "metadata": (
        "struct<extractor_version:string,extraction_timestamp:timestamp,processing_time_ms:int,"
        "confidence_score:double,source_file_hash:string,file_size_bytes:bigint,file_type:string,"
        "sections_detected:array<string>,language_detected:string,character_count:int,structure_score:double,"
        "completeness_score:double>"
    ),
    "warnings": "array<string>",
    "errors": "array<string>",
}
PROFILE_DDL = "struct<" + ",".join(f"{k}:{v}" for k, v in PROFILE_FIELDS.items()) + ">"
PROFILE_COLUMNS_DDL = ", ".join(f"{k} {v}" for k, v in PROFILE_FIELDS.items())



def _null(dtype: str = "string") -> Column:
    return F.lit(None).cast(dtype)


def date_range(start: Column, end: Column, current: Column, raw: Column) -> Column:
    """A date range, or null when nothing is known; recognised dates in ISO form, other text as it is."""
    known = F.coalesce(start, end, raw).isNotNull() | F.coalesce(current, F.lit(False))
    built = F.struct(
        iso_date_or_text(start).alias("start_date"),
        iso_date_or_text(end).alias("end_date"),
        F.coalesce(current, F.lit(False)).alias("is_current"),
        raw.alias("raw_date_text"),
    )
    return F.when(known, built)


def _raw_range(text: Column) -> Column:
    return date_range(_null(), _null(), F.lit(False), blank_to_null(text))


def contact_of(contact: Column) -> Column:
    """Profile contact; links are sorted into LinkedIn, GitHub and website by host."""

    def build(urls: Column) -> Column:
        host = lambda name: F.get(F.filter(urls, lambda u: F.contains(F.lower(u), F.lit(name))), F.lit(0))
        others = F.filter(urls, lambda u: ~F.lower(u).rlike(r"linkedin\.com|github\.com"))
        return F.struct(
            _null().alias("full_name"),
            contact["email"].alias("email"),
            contact["phone"].alias("phone"),
            _null().alias("location"),
            F.get(others, F.lit(0)).alias("website"),
            host("linkedin.com").alias("linkedin"),
            host("github.com").alias("github"),
            _null().alias("address"),
            F.create_map().cast("map<string,string>").alias("social_profiles"),
        )

    empty = contact["email"].isNull() & contact["phone"].isNull() & (F.size(contact["urls"]) == 0)
    return F.when(~empty, let(F.coalesce(contact["urls"], no_strings()), build))


def _experience(items: Column) -> Column:
    return F.transform(
        items,
        lambda x: F.struct(
            x["company"].alias("company"),
            x["title"].alias("position"),
            _null().alias("location"),
            _raw_range(x["duration"]).alias("dates"),
            _null().alias("description"),
            x["responsibilities"].alias("responsibilities"),
            no_strings().alias("technologies"),
            F.lit(0.0).alias("confidence_score"),
            no_strings().alias("warnings"),
        ),
    )


def _education(items: Column) -> Column:
    return F.transform(
        items,
        lambda x: F.struct(
            x["institution"].alias("institution"),
            x["degree"].alias("degree"),
            _null().alias("field_of_study"),
            _null().alias("location"),
            _raw_range(x["year"]).alias("dates"),
            _null().alias("gpa"),
            no_strings().alias("honors"),
            no_strings().alias("relevant_coursework"),
            F.lit(0.0).alias("confidence_score"),
            no_strings().alias("warnings"),
        ),
    )


def _skills(items: Column) -> Column:
    return F.transform(
        items,
        lambda s: F.struct(
            s.alias("name"),
            _null().alias("category"),
            _null().alias("proficiency_level"),
            _null("int").alias("years_experience"),
            _null().alias("canonical_name"),
            no_strings().alias("aliases"),
            _null().alias("context"),
            F.lit(1.0).alias("confidence_score"),
        ),
    )


def _projects(items: Column) -> Column:
    return F.transform(
        items,
        lambda x: F.struct(
            F.coalesce(blank_to_null(x["name"]), F.lit("Unnamed Project")).alias("name"),
            x["description"].alias("description"),
            _null().alias("url"),
            date_range(_null(), _null(), F.lit(False), _null()).alias("dates"),
            x["technologies"].alias("technologies"),
            _null().alias("role"),
            _null("int").alias("team_size"),
            F.lit(0.0).alias("confidence_score"),
        ),
    )


def _achievements(items: Column) -> Column:
    return F.transform(
        items,
        lambda t: F.struct(
            F.coalesce(blank_to_null(t), F.lit("Achievement")).alias("title"),
            *[
                _null().alias(c)
                for c in (
                    "organization", "date_received", "description", "type",
                    "expiration_date", "credential_id", "verification_url",
                )
            ],
        ),
    )


def profile_of(
    result: Column,
    path: Column,
    as_of: Column,
    *,
    file_hash: Column | None = None,
    file_size: Column | None = None,
    text: Column | None = None,
    skills: Column | None = None,
) -> Column:
    """Profile struct from a parser result; null where there is no result.

    Only the file name is kept of the path. ``skills`` takes an already normalised skill
    array (``operators.skills.normalize_lists``) instead of the raw names.
    """
    s = result["sections"]
    source = F.coalesce(basename(path), F.lit("unknown.docx"))
    detected = F.array(*[F.lit(k) for k in ("contact", "summary", "experience", "education", "skills", "projects", "achievements")])
    normalised = None
    if skills is not None:
        normalised = F.transform(
            skills,
            lambda x: F.struct(
                x["name"].alias("name"),
                x["category"].alias("category"),
                _null().alias("proficiency_level"),
                _null("int").alias("years_experience"),
                x["canonical_name"].alias("canonical_name"),
                x["aliases"].alias("aliases"),
                x["context"].alias("context"),
                x["confidence_score"].alias("confidence_score"),
            ),
        )
    built = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        as_of.alias("generated_at"),
        result["extraction_method"].alias("extraction_method"),
        source.alias("source_file"),
        contact_of(s["contact"]).alias("contact"),
        F.when(
            s["summary"] != "",
            F.struct(s["summary"].alias("text"), _null().alias("objective"), no_strings().alias("keywords")),
        ).alias("summary"),
        _experience(s["experience"]).alias("experience"),
        _education(s["education"]).alias("education"),
        (_skills(s["skills"]) if normalised is None else normalised).alias("skills"),
        _projects(s["projects"]).alias("projects"),
        _achievements(s["achievements"]).alias("achievements"),
        _null().alias("additional_sections"),
        F.struct(
            result["metadata"]["extractor_version"].alias("extractor_version"),
            as_of.alias("extraction_timestamp"),
            _null("int").alias("processing_time_ms"),
            result["metadata"]["confidence_score"].alias("confidence_score"),
            (_null() if file_hash is None else file_hash).alias("source_file_hash"),
            (_null("bigint") if file_size is None else file_size.cast("bigint")).alias("file_size_bytes"),
            type_of_name(source).alias("file_type"),
            detected.alias("sections_detected"),
            _null().alias("language_detected"),
            (_null("int") if text is None else F.length(text)).alias("character_count"),
            _null("double").alias("structure_score"),
            _null("double").alias("completeness_score"),
        ).alias("metadata"),
        result["warnings"].alias("warnings"),
        no_strings().alias("errors"),
    )
    return F.when(result.isNotNull(), built)


def profile_size(profile: Column) -> Column:
    """Contact and summary count one each, list sections by their length."""
    size = profile["contact"].isNotNull().cast("int") + profile["summary"].isNotNull().cast("int")
    for section in ("experience", "education", "skills"):
        size = size + F.greatest(F.coalesce(F.size(profile[section]), F.lit(0)), F.lit(0))
    return size.cast("long")


def to_profile_json(profile: Column) -> Column:
    """JSON with ISO times and dates; absent values are left out."""
    return F.to_json(
        profile, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd"}
    )


# ------------------------------------------------------------------ loosely shaped input


_DATES_READ = (
    "struct<start_date:string,start:string,end_date:string,end:string,raw_date_text:string,raw:string,is_current:boolean>"
)
#: What is read of the objects of parser JSON; a field of another type is null, and so is an object that is none.
_READ = {
    "parser": (
        "struct<extraction_method:string,file_path:string,sections:map<string,variant>,"
        "metadata:struct<extractor_version:string,confidence_score:double>,warnings:array<string>>"
    ),
    "contact": (
        "struct<name:string,full_name:string,email:string,phone:string,location:string,website:string,linkedin:string,"
        "github:string,address:string,social_profiles:map<string,string>>"
    ),
    "summary": "struct<text:string,objective:string,keywords:array<string>>",
    "experience": (
        f"struct<company:string,position:string,title:string,location:string,dates:{_DATES_READ},duration:string,year:string,"
        "description:string,responsibilities:array<string>,technologies:array<string>,confidence_score:double,warnings:array<string>>"
    ),
    "education": (
        f"struct<institution:string,school:string,degree:string,field_of_study:string,major:string,location:string,dates:{_DATES_READ},"
        "duration:string,year:string,gpa:string,honors:array<string>,relevant_coursework:array<string>,confidence_score:double,"
        "warnings:array<string>>"
    ),
    "skills": (
        "struct<name:string,category:string,proficiency_level:string,years_experience:int,canonical_name:string,"
        "aliases:array<string>,context:string,confidence_score:double>"
    ),
    "projects": (
        f"struct<name:string,title:string,description:string,url:string,link:string,dates:{_DATES_READ},duration:string,year:string,"
        "technologies:array<string>,role:string,team_size:int,confidence_score:double>"
    ),
    "achievements": (
        "struct<title:string,name:string,organization:string,issuer:string,date_received:string,date:string,description:string,"
        "type:string,expiration_date:string,credential_id:string,verification_url:string>"
    ),
}


def _read(v: Column, kind: str) -> Column:
    """A variant object as a struct, in one pass over its fields."""
    return F.try_variant_get(v, "$", kind)


def _text(o: Column, *names: str) -> Column:
    """First non-empty of some fields."""
    return F.coalesce(*[blank_to_null(o[n]) for n in names])


def _strings(o: Column, name: str) -> Column:
    return F.coalesce(o[name], no_strings())


def _objects(v: Column, kind: str) -> Column:
    """Object items of a list; anything else in the list is left out."""
    items = F.coalesce(_read(v, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    return F.filter(items, lambda o: o.isNotNull())


def _read_dates(o: Column) -> Column:
    d = o["dates"]
    parts = F.array(_text(d, "start_date", "start"), _text(d, "end_date", "end"), _text(d, "raw_date_text", "raw"))
    dates = F.when(d.isNotNull(), let(parts, lambda p: date_range(p[0], p[1], d["is_current"], p[2])))
    return F.coalesce(dates, _raw_range(_text(o, "duration", "year")))


def _number(o: Column, name: str, default: float) -> Column:
    return F.coalesce(o[name], F.lit(default))


def profile_of_json(parser_json: Column, as_of: Column) -> Column:
    """Profile from the JSON of any parser, with the usual synonyms for field names.

    ``title`` stands for position, ``school`` for institution, ``major`` for field of study,
    ``link`` for url, ``issuer`` for organisation, ``date`` for date received, ``start`` /
    ``end`` / ``raw`` for the parts of a date range. Skills and achievements may be plain
    strings. Every object is read once, as a struct (``_READ``).
    """
    no_items = F.array().cast("array<variant>")

    def contact(c: Column) -> Column:
        def build(o: Column) -> Column:
            fields = [_text(o, n).alias(n) for n in ("email", "phone", "location", "website", "linkedin", "github", "address")]
            social = F.coalesce(o["social_profiles"], F.create_map().cast("map<string,string>"))
            built = F.struct(_text(o, "name", "full_name").alias("full_name"), *fields, social.alias("social_profiles"))
            return F.when(o.isNotNull(), built)

        return let(_read(c, _READ["contact"]), build)

    def summary(m: Column) -> Column:
        def build(o: Column) -> Column:
            as_object = F.struct(
                _text(o, "text").alias("text"), _text(o, "objective").alias("objective"), _strings(o, "keywords").alias("keywords")
            )
            as_text = F.struct(
                _read(m, "string").alias("text"), _null().alias("objective"), no_strings().alias("keywords")
            )
            return F.when(o.isNotNull(), as_object).when((F.schema_of_variant(m) == "STRING") & (_read(m, "string") != ""), as_text)

        return let(_read(m, _READ["summary"]), build)

    def objects_or_strings(v: Column, kind: str, build: Callable[[Column, Column], Column]) -> Column:
        """``build(item, its object)`` of every item that is an object or (without object) a string."""

        def one(x: Column) -> Column:
            return let(_read(x, kind), lambda o: F.when(o.isNotNull() | (F.schema_of_variant(x) == "STRING"), build(x, o)))

        return F.filter(F.transform(F.coalesce(_read(v, "array<variant>"), no_items), one), lambda y: y.isNotNull())

    def skill(x: Column, o: Column) -> Column:
        return F.struct(
            F.coalesce(_text(o, "name"), _read(x, "string")).alias("name"),
            _text(o, "category").alias("category"),
            _text(o, "proficiency_level").alias("proficiency_level"),
            o["years_experience"].alias("years_experience"),
            _text(o, "canonical_name").alias("canonical_name"),
            _strings(o, "aliases").alias("aliases"),
            _text(o, "context").alias("context"),
            _number(o, "confidence_score", 1.0).alias("confidence_score"),
        )

    def achievement(x: Column, o: Column) -> Column:
        return F.struct(
            F.coalesce(F.when(o.isNull(), _read(x, "string")), _text(o, "title", "name"), F.lit("Achievement")).alias("title"),
            _text(o, "organization", "issuer").alias("organization"),
            _text(o, "date_received", "date").alias("date_received"),
            *[
                _text(o, n).alias(n)
                for n in ("description", "type", "expiration_date", "credential_id", "verification_url")
            ],
        )

    def assemble(v: Column) -> Column:
        s = v["sections"]
        section = lambda name: F.try_element_at(s, F.lit(name))
        experience = F.transform(
            _objects(section("experience"), _READ["experience"]),
            lambda o: F.struct(
                _text(o, "company").alias("company"),
                _text(o, "position", "title").alias("position"),
                _text(o, "location").alias("location"),
                _read_dates(o).alias("dates"),
                _text(o, "description").alias("description"),
                _strings(o, "responsibilities").alias("responsibilities"),
                _strings(o, "technologies").alias("technologies"),
                _number(o, "confidence_score", 0.0).alias("confidence_score"),
                _strings(o, "warnings").alias("warnings"),
            ),
        )
        education = F.transform(
            _objects(section("education"), _READ["education"]),
            lambda o: F.struct(
                _text(o, "institution", "school").alias("institution"),
                _text(o, "degree").alias("degree"),
                _text(o, "field_of_study", "major").alias("field_of_study"),
                _text(o, "location").alias("location"),
                _read_dates(o).alias("dates"),
                _text(o, "gpa").alias("gpa"),
                _strings(o, "honors").alias("honors"),
                _strings(o, "relevant_coursework").alias("relevant_coursework"),
                _number(o, "confidence_score", 0.0).alias("confidence_score"),
                _strings(o, "warnings").alias("warnings"),
            ),
        )
        projects = F.transform(
            _objects(section("projects"), _READ["projects"]),
            lambda o: F.struct(
                F.coalesce(_text(o, "name", "title"), F.lit("Unnamed Project")).alias("name"),
                _text(o, "description").alias("description"),
                _text(o, "url", "link").alias("url"),
                _read_dates(o).alias("dates"),
                _strings(o, "technologies").alias("technologies"),
                _text(o, "role").alias("role"),
                o["team_size"].alias("team_size"),
                _number(o, "confidence_score", 0.0).alias("confidence_score"),
            ),
        )

        def build(source: Column) -> Column:
            return F.struct(
                F.lit(SCHEMA_VERSION).alias("schema_version"),
                as_of.alias("generated_at"),
                F.coalesce(_text(v, "extraction_method"), F.lit("unknown")).alias("extraction_method"),
                source.alias("source_file"),
                contact(section("contact")).alias("contact"),
                let(section("summary"), summary).alias("summary"),
                experience.alias("experience"),
                education.alias("education"),
                objects_or_strings(section("skills"), _READ["skills"], skill).alias("skills"),
                projects.alias("projects"),
                objects_or_strings(section("achievements"), _READ["achievements"], achievement).alias("achievements"),
                _null().alias("additional_sections"),
                F.struct(
                    F.coalesce(v["metadata"]["extractor_version"], F.lit("0.1.0")).alias("extractor_version"),
                    as_of.alias("extraction_timestamp"),
                    _null("int").alias("processing_time_ms"),
                    F.coalesce(v["metadata"]["confidence_score"], F.lit(0.0)).alias("confidence_score"),
                    _null().alias("source_file_hash"),
                    _null("bigint").alias("file_size_bytes"),
                    type_of_name(source).alias("file_type"),
                    F.coalesce(F.map_keys(s), no_strings()).alias("sections_detected"),
                    _null().alias("language_detected"),
                    _null("int").alias("character_count"),
                    _null("double").alias("structure_score"),
                    _null("double").alias("completeness_score"),
                ).alias("metadata"),
                _strings(v, "warnings").alias("warnings"),
                no_strings().alias("errors"),
            )

        return let(F.coalesce(basename(_text(v, "file_path")), F.lit("unknown.docx")), build)

    def read(v: Column) -> Column:
        return F.when(v.isNotNull(), let(_read(v, _READ["parser"]), assemble))

    return let(F.try_parse_json(parser_json), read)


def with_profiles(parsed: DataFrame, path: Column, as_of: Column, **known: Column) -> DataFrame:
    return parsed.withColumn("profile", profile_of(F.col("result"), path, as_of, **known))
