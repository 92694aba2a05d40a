"""JSON that a model has written: repaired, and brought into one shape."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.normalize import any_date

#: What is kept of an object that breaks off: single values, and lists by the names they may have. Fixed values.
VALUES = ("summary", "case_type", "county", "trial_judge", "source_docket_number", "appeal_outcome", "winner_legal_role", "winner_personal_role")
LISTS = (("parties_parsed", "parties"), ("judicial_panel", "judges"), ("legal_representation",), ("citations",), ("statutes",), ("issues",))

_HALF = re.compile("[\ud800-\udfff]")
_BLANK = re.compile(r"[\s,]*")
_SCALAR = re.compile(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?=[\s,}\]]|$)")
#: What may stand behind a string: the end of its container, a colon, or a comma and the next key, value or end.
_BEHIND = re.compile(r"""\s*(?:$|[:}\]]|,\s*(?:$|["'{}\[\]\d-]|true\b|false\b|null\b))""")


def _string(text: str, at: int) -> tuple[str, int] | None:
    """The string whose quote, of either kind, stands at ``at``, and where it ends: at a quote behind which a string may end, so that others count as text."""
    quote, mark, begin = text[at], re.compile(rf"\\.|{text[at]}", re.DOTALL), at + 1
    parts: list[str] = []
    for found in mark.finditer(text, at + 1):
        if found[0] == quote:
            parts.append(text[begin : found.start()])
            if _BEHIND.match(text, found.end()):
                body = "".join(parts)
                try:
                    return json.loads(f'"{body}"', strict=False), found.end()
                except ValueError:
                    return body, found.end()
            parts.append("\\" + quote if quote == '"' else quote)
            begin = found.end()
        elif found[0] == "\\'":
            parts += text[begin : found.start()], "'"
            begin = found.end()
        elif quote == "'" and found[0] == '"':
            continue
    return None


def scanned(text: str, at: int = 0) -> tuple[dict, bool]:
    """The object that opens at ``at``, read as far as it can be, and whether it was read to its end.

    Commas may lack or be too many, quotes may be single or stand unescaped inside strings. An object
    that breaks off has the members that are whole. What is open is kept on a stack, so depth is no limit.
    """
    root: dict = {}
    stack: list[tuple[dict | list, str | None]] = [(root, None)]
    at += 1
    while True:
        inner, _ = stack[-1]
        key = None
        at = _BLANK.match(text, at).end()
        if at < len(text) and text[at] == ("}" if isinstance(inner, dict) else "]"):
            done, name = stack.pop()
            if not stack:
                return root, True
            _put(stack[-1][0], name, done)
            at += 1
            continue
        if isinstance(inner, dict):
            named = _string(text, at) if at < len(text) and text[at] in "\"'" else None
            colon = re.compile(r"\s*:\s*").match(text, named[1]) if named else None
            if not colon:
                return root, False
            key, at = named[0], colon.end()
        if at >= len(text):
            return root, False
        if text[at] in "{[":
            stack.append(({} if text[at] == "{" else [], key))
            at += 1
            continue
        if text[at] in "\"'":
            value = _string(text, at)
        else:
            plain = _SCALAR.match(text, at)
            value = (_scalar(plain[1]), plain.end()) if plain else None
        if value is None:
            return root, False
        _put(inner, key, value[0])
        at = value[1]


def _scalar(text: str) -> object:
    """A number, true, false or null; a number that JSON or Python doesn't take, as with zeros in front or thousands of digits, is its text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def _put(inner: dict | list, key: str | None, value: object) -> None:
    if isinstance(inner, dict):
        inner[key] = value
    else:
        inner.append(value)


def repair(response: str) -> dict:
    """The object in a model's answer, whatever surrounds it; of one that breaks off, the known values and lists that are whole; empty without any."""
    start, end = response.find("{"), response.rfind("}") + 1
    if start < 0:
        return {}
    try:
        return json.loads(response[start:end])
    except (ValueError, RecursionError):
        found, whole = scanned(response, start)
    if whole:
        return found
    kept = {name: found[name] for name in VALUES if isinstance(found.get(name), str)}
    for names in LISTS:
        own = [found[n] for n in names if isinstance(found.get(n), list)]
        if own:
            kept[names[0]] = own[0]
    return kept


def _written(answer: str | None) -> str | None:
    """The repaired object as JSON; one too deep to be written is empty."""
    try:
        out = None if answer is None else json.dumps(repair(answer), sort_keys=True, ensure_ascii=False)
    except RecursionError:
        return "{}"
    return out and _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", out)  # halves of a pair, which only escapes can hold, stay escaped


@F.pandas_udf(T.StringType())
def repaired(answers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """An answer's object as JSON with its keys in order; null stays null."""
    for batch in answers:
        yield batch.map(_written)


def _get(doc: Column, *paths: str) -> Column:
    """The first value of the paths that is there and not blank."""
    return F.coalesce(*[F.nullif(F.get_json_object(doc, f"$.{p}"), F.lit("")) for p in paths])


def _list(doc: Column, fields: str, *paths: str) -> Column:
    """The first of the paths that is there, as an array of structs of strings; empty without any."""
    kind = "array<struct<" + ",".join(f"{f}:string" for f in fields.split()) + ">>"
    return F.coalesce(*[F.from_json(F.get_json_object(doc, f"$.{p}"), kind) for p in paths], F.array().cast(kind))


def _known(value: Column) -> Column:
    return F.when(F.lower(value) != "null", value)


def harmonised(doc: Column) -> Column:
    """One shape for objects of either schema: values by any of their names, parties, judges, attorneys, citations, statutes and issues without those that lack what names them."""
    party = _list(doc, "name role appellate_role trial_role party_type type personal_role", "parties", "parties_parsed")
    attorney = _list(doc, "name attorney_name representing firm_name firm_or_agency", "attorneys", "legal_representation")
    judge = _list(doc, "name judge_name role", "judges", "judicial_panel")
    citation = _list(doc, "full_citation case_name relationship", "citations", "cases_cited")
    statute = F.coalesce(F.from_json(F.get_json_object(doc, "$.statutes"), "array<struct<citation:string,title:string>>"), F.transform(F.from_json(F.get_json_object(doc, "$.legal_analysis.key_statutes_cited"), "array<string>"), lambda x: F.struct(x.alias("citation"), F.lit(None).cast("string").alias("title"))), F.array().cast("array<struct<citation:string,title:string>>"))
    fields = "summary question case_type category subcategory outcome winner winner_legal_role ruling decision_summary decision_stage"
    own = _list(doc, fields, "issues", "legal_analysis.issues")
    major = F.transform(_list(doc, "question ruling outcome", "legal_analysis.major_issues"), lambda x: F.struct(x["question"].alias("summary"), F.lit("Other").alias("case_type"), F.lit("Other").alias("category"), F.lit("General").alias("subcategory"), x["outcome"].alias("outcome"), F.lit(None).cast("string").alias("winner"), x["ruling"].alias("decision_summary"), F.lit("appeal").alias("decision_stage")))

    def issue(x: Column) -> Column:
        return F.struct(
            F.coalesce(F.nullif(x["summary"], F.lit("")), x["question"]).alias("summary"), F.coalesce(x["case_type"], F.lit("Other")).alias("case_type"), F.coalesce(x["category"], F.lit("General")).alias("category"),
            F.coalesce(F.nullif(x["subcategory"], F.lit("")), F.lit("General")).alias("subcategory"), x["outcome"].alias("outcome"), F.coalesce(F.nullif(x["winner"], F.lit("")), x["winner_legal_role"]).alias("winner"),
            F.coalesce(F.nullif(x["ruling"], F.lit("")), x["decision_summary"]).alias("decision_summary"), F.coalesce(x["decision_stage"], F.lit("appeal")).alias("decision_stage"),
        )

    def side(x: Column) -> Column:
        role = F.coalesce(F.nullif(x["role"], F.lit("")), F.nullif(x["appellate_role"], F.lit("")), F.lit("Unknown"))
        trial = F.when(x["trial_role"] != "", F.when(x["trial_role"] != "null", x["trial_role"]))
        return F.struct(x["name"].alias("name"), F.when(trial.isNotNull(), F.concat(role, F.lit(" ("), trial, F.lit(")"))).otherwise(role).alias("role"), F.coalesce(F.nullif(x["party_type"], F.lit("")), x["type"]).alias("party_type"), _known(x["personal_role"]).alias("personal_role"))

    named = lambda a, f: F.filter(F.transform(a, f), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    has_issues = F.get_json_object(doc, "$.issues").isNotNull() | F.get_json_object(doc, "$.legal_analysis.issues").isNotNull()
    return F.struct(
        F.coalesce(F.get_json_object(doc, "$.summary"), F.lit("")).alias("summary"),
        F.trim(F.split_part(F.coalesce(_get(doc, "case_type", "case_category"), F.lit("")), F.lit("|"), F.lit(1))).alias("case_type"),
        _get(doc, "county", "originating_court.county").alias("county"),
        _get(doc, "trial_court", "originating_court.court_name").alias("trial_court"),
        _get(doc, "trial_judge", "originating_court.trial_judge").alias("trial_judge"),
        _get(doc, "source_docket_number", "originating_court.source_docket_number").alias("source_docket_number"),
        _get(doc, "appeal_outcome", "outcome.disposition").alias("appeal_outcome"),
        _get(doc, "outcome_detail", "outcome.details").alias("outcome_detail"),
        _get(doc, "winner_legal_role", "outcome.prevailing_party").alias("winner_legal_role"),
        _get(doc, "winner_personal_role", "outcome.winner_personal_role").alias("winner_personal_role"),
        any_date(_get(doc, "procedural_dates.opinion_filed_date", "opinion_filed_date")).alias("opinion_filed_date"),
        named(party, side).alias("parties"),
        named(attorney, lambda x: F.struct(F.coalesce(F.nullif(x["name"], F.lit("")), x["attorney_name"]).alias("name"), F.coalesce(x["representing"], F.lit("Unknown")).alias("representing"), F.coalesce(F.nullif(x["firm_name"], F.lit("")), x["firm_or_agency"]).alias("firm_name"))).alias("attorneys"),
        named(judge, lambda x: F.struct(F.coalesce(F.nullif(x["name"], F.lit("")), x["judge_name"]).alias("name"), F.coalesce(x["role"], F.lit("Unknown")).alias("role"))).alias("judges"),
        F.filter(citation, lambda x: F.coalesce(x["full_citation"], F.lit("")) != "").alias("citations"),
        F.filter(statute, lambda x: F.coalesce(x["citation"], F.lit("")) != "").alias("statutes"),
        F.filter(F.when(has_issues, F.transform(own, issue)).otherwise(major), lambda x: F.coalesce(x["summary"], F.lit("")) != "").alias("issues"),
    )


#: Names that say that none was found. Fixed values.
PLACEHOLDERS = ("unknown", "n/a", "none", "not specified", "")


def overridden(rules: dict[str, Column], model: dict[str, Column], lists: tuple[Column, Column], judges: tuple[Column, Column]) -> dict[str, Column]:
    """Single values of the rules before those of the model; the model's parties unless all their names are placeholders; judges of both, each name once."""
    out = {k: F.coalesce(rules[k], model.get(k, F.lit(None))) for k in rules}
    of_rules, of_model = lists
    real = F.exists(of_model, lambda p: ~F.lower(F.trim(p["name"])).isin(*PLACEHOLDERS))
    out["parties"] = F.when((F.size(of_rules) > 0) & ~F.coalesce(real, F.lit(False)), of_rules).otherwise(of_model)
    known = F.transform(judges[1], lambda j: F.lower(j["name"]))
    out["judges"] = F.concat(judges[1], F.filter(judges[0], lambda j: ~F.array_contains(known, F.lower(j["name"]))))
    return out
