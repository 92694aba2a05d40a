"""Normalisers of names, numbers, roles and outcomes, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.extract import title_case


def _has(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


#: Outcomes of issues by the first test that the lower-case value passes: it holds all the words. Fixed values.
ISSUE_OUTCOMES = (
    (("in part",), "Mixed"),
    (("partial",), "Mixed"),
    (("split",), "Mixed"),
    (("affirm", "revers"), "Mixed"),
    (("affirm", "remand"), "Mixed"),
    (("revers", "remand"), "Mixed"),
    (("affirm",), "Affirmed"),
    (("dismiss",), "Dismissed"),
    (("revers",), "Reversed"),
    (("remand",), "Remanded"),
    (("mixed",), "Mixed"),
    (("denied",), "Affirmed"),
    (("deny",), "Affirmed"),
    (("grant",), "Reversed"),
    (("vacat",), "Reversed"),
    (("sustain",), "Affirmed"),
    (("overrul",), "Reversed"),
)


def _by_words(value: Column, tests: tuple, otherwise: Column | str | None = None) -> Column:
    """The value of the first of ``tests`` (words, value) all of whose words the lower-case text holds."""
    t = F.lower(F.trim(value))
    cases = [F.when(reduce(lambda a, b: a & b, [t.contains(w) for w in words]), F.lit(v)) for words, v in tests]
    return F.coalesce(*cases, *([] if otherwise is None else [F.lit(otherwise) if isinstance(otherwise, str) else otherwise]))


def issue_outcome(value: Column) -> Column:
    """One of five outcomes; unknown values stay; a blank one is null."""
    return F.when(value != "", _by_words(value, ISSUE_OUTCOMES, value))


#: Fixed values.
NOT_ROLES = ("affirmed", "reversed", "remanded", "dismissed", "mixed", "affirmed in part", "reversed in part", "partial")
ROLES = ("Appellant", "Respondent", "Petitioner", "State", "Plaintiff", "Defendant", "Neither")


def winner_role(value: Column) -> Column:
    """Outcomes aren't roles; known roles get their spelling; others are trimmed."""
    t = F.trim(value)
    known = F.coalesce(*[F.when(F.lower(t) == r.lower(), r) for r in ROLES], t)
    return F.when((t != "") & ~F.lower(t).isin(*NOT_ROLES), known)


#: Patterns of statutes. Fixed values.
STATUTE = r"(?i)^(RCW)\s+(\d+)\.([0-9A-Za-z.]+)((?:\([^)]+\))+)?"
RCW = r"(?i)^RCW\s*(\d+)\.(\w+)\.(\d+)(?:\(([^)]+(?:\([^)]+\))*)\))?"


def statute_parts(value: Column) -> Column:
    """struct(code, title, section, subsection)."""
    pattern = STATUTE
    names = ("code", "title", "section", "subsection")
    return F.struct(*[(F.upper(_group(F.trim(value), pattern, k)) if k == 1 else _group(F.trim(value), pattern, k)).alias(n) for k, n in enumerate(names, 1)])


def rcw_parts(value: Column) -> Column:
    """struct(title, chapter, section, subsection, full_citation); only the first parenthesis counts."""
    pattern = RCW
    title, chapter, section, sub = (_group(value, pattern, k) for k in range(1, 5))
    full = F.concat(F.lit("RCW "), title, F.lit("."), chapter, F.lit("."), section, F.coalesce(F.concat(F.lit("("), sub, F.lit(")")), F.lit("")))
    return F.struct(title.alias("title"), chapter.alias("chapter"), section.alias("section"), sub.alias("subsection"), full.alias("full_citation"))


def rcw_split(value: Column) -> Column:
    """struct(title, section): up to the first dot, and the rest."""
    parts = F.split(value, r"\.")
    return F.struct(parts[0].alias("title"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ".").alias("section"))


DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM. d, yyyy", "MMM d, yyyy", "M/d/yyyy")


def any_date(value: Column) -> Column:
    """The first format that fits; words for null and anything else are null."""
    t = F.trim(value)
    good = F.when(~F.lower(t).isin("", "null", "none", "n/a", "unknown"), t)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(good, F.lit(f))) for f in DATE_FORMATS])


def county(value: Column) -> Column:
    """E24."""
    return F.when((value != "") & (value != "Unknown"), F.regexp_replace(F.trim(value), r"(?i)(?<!\s)\s*+County\s*$", ""))


def digits(value: Column) -> Column:
    """Case numbers are compared by their digits."""
    return F.regexp_replace(value, "[^0-9]", "")


def brief_file(path: Column) -> Column:
    """struct(case_file_id, brief_type, filing_party, source_file, year) of a brief's path; the id is null without five digits."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    number, low = F.regexp_extract(stem, r"^(\d+)", 1), F.lower(stem)
    case_id = F.when(F.length(number) >= 5, F.concat(F.substring(number, 1, 5), F.lit("-"), F.coalesce(F.nullif(F.substring(number, 6, 1), F.lit("")), F.lit("0"))))
    party = F.coalesce(F.when(_has(low, "appellant", "petitioner"), "Appellant"), F.when(low.contains("respondent"), "Respondent"), F.lit("Unknown"))

    def kind(base: str, test: Column) -> list[Column]:
        return [F.when(test & low.contains("supplemental"), f"Supplemental {base}"), F.when(test & low.contains("amended"), f"Amended {base}"), F.when(test, base)]

    brief = F.coalesce(
        *kind("Reply", low.contains("reply")), *kind("Response", _has(low, "response", "answer")), F.when(_has(low, "opening", "initial"), "Opening"),
        F.when(low.contains("additional_grounds"), "Statement of Additional Grounds"), F.when(low.contains("supplemental"), "Supplemental Brief"), F.when(low.contains("amended"), "Amended Brief"),
        F.when(party == "Appellant", "Opening"), F.when(party == "Respondent", "Response"), F.lit("Unknown"),
    )
    year = F.regexp_extract(path, r"(?:^|/)(\d{4})-briefs", 1).try_cast("int")
    return F.struct(case_id.alias("case_file_id"), brief.alias("brief_type"), party.alias("filing_party"), name.alias("source_file"), year.alias("year"))


def brief_suffix(stem: Column) -> Column:
    """The last part of the name where it is a number."""
    last = F.element_at(F.split(stem, "_"), -1)
    return F.when(last.rlike(r"^\d+$"), last)


def mapped(value: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """Lower-case lookup; else ``otherwise``, by default null."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.lower(F.trim(value)))
    return found if otherwise is None else F.coalesce(found, otherwise)


def published(status: Column, strict: bool = True) -> Column:
    """Whether a status says published; not strict, "Unpublished" does too."""
    t = F.lower(status)
    return F.coalesce(t.contains("published") & ~(t.contains("unpublished") if strict else F.lit(False)), F.lit(False))


def one_line(value: Column) -> Column:
    """Blank runs are one blank; a blank value is null."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


#: Fixed values.
APPEAL_OUTCOMES = (
    (("remand", "partial"), "Remanded Partial"),
    (("remand", "full"), "Remanded Full"),
    (("remand",), "Remanded"),
    (("affirm",), "Affirmed"),
    (("revers",), "Reversed"),
    (("dismiss",), "Dismissed"),
    (("partial",), "Partial"),
    (("split",), "Split"),
)


def appeal_outcome(value: Column) -> Column:
    """Like E18 with another order of rules; unknown values are Unknown."""
    return _by_words(value, APPEAL_OUTCOMES, "Unknown")


def section_kind(text: Column) -> Column:
    """The first group of words of which the text holds one. Fixed values."""
    t = F.lower(text)
    groups = (("FACTS", ("facts", "background", "procedural history")), ("ANALYSIS", ("analysis", "discussion", "legal standard")), ("CONCLUSION", ("conclusion", "holding", "we conclude", "affirm", "reverse")), ("CUSTODY", ("custody", "parenting plan", "residential time")), ("SUPPORT", ("support", "maintenance", "alimony")), ("PROPERTY", ("property", "assets", "debt")), ("FEES", ("attorney fees", "costs")))
    return F.coalesce(*[F.when(_has(t, *words), name) for name, words in groups], F.lit("GENERAL"))


#: Section classes of briefs by words of which the text holds one. Fixed values.
BRIEF_SECTIONS = (
    ("TABLE_OF_AUTHORITIES", ("table of authorities", "table of cases", "authorities cited")),
    ("STATEMENT_OF_CASE", ("statement of the case", "procedural history")),
    ("STATEMENT_OF_FACTS", ("statement of facts", "facts", "background")),
    ("ISSUES", ("issues presented", "questions presented", "issues")),
    ("ARGUMENT", ("argument", "discussion", "analysis")),
    ("CONCLUSION", ("conclusion", "prayer for relief", "relief requested")),
)


def brief_section(text: Column) -> Column:
    """The first class of BRIEF_SECTIONS, GENERAL without any."""
    return F.coalesce(*[F.when(_has(F.lower(text), *words), name) for name, words in BRIEF_SECTIONS], F.lit("GENERAL"))


#: Issue categories by name, in the order in which parts of names are tried. Fixed values.
ISSUE_CATEGORIES = {
    "criminal law & procedure": "Criminal Law & Procedure",
    "criminal law": "Criminal Law & Procedure",
    "criminal": "Criminal Law & Procedure",
    "criminal procedure": "Criminal Law & Procedure",
    "search & seizure": "Criminal Law & Procedure",
    "fourth amendment": "Criminal Law & Procedure",
    "sentencing": "Criminal Law & Procedure",
    "firearm possession": "Criminal Law & Procedure",
    "unlawful possession": "Criminal Law & Procedure",
    "constitutional law": "Constitutional Law",
    "constitutional": "Constitutional Law",
    "due process": "Constitutional Law",
    "equal protection": "Constitutional Law",
    "first amendment": "Constitutional Law",
    "civil rights": "Constitutional Law",
    "civil procedure": "Civil Procedure",
    "summary judgment": "Civil Procedure",
    "motion to dismiss": "Civil Procedure",
    "statute of limitations": "Civil Procedure",
    "standing": "Civil Procedure",
    "evidence": "Evidence",
    "hearsay": "Evidence",
    "expert testimony": "Evidence",
    "sufficiency of evidence": "Evidence",
    "insufficient evidence": "Evidence",
    "contracts": "Contracts",
    "contract": "Contracts",
    "breach of contract": "Contracts",
    "torts / personal injury": "Torts / Personal Injury",
    "torts": "Torts / Personal Injury",
    "tort": "Torts / Personal Injury",
    "personal injury": "Torts / Personal Injury",
    "negligence": "Torts / Personal Injury",
    "civil liability": "Torts / Personal Injury",
    "title ix": "Torts / Personal Injury",
    "property law": "Property Law",
    "property": "Property Law",
    "real property": "Property Law",
    "employment law": "Employment Law",
    "employment": "Employment Law",
    "labor": "Employment Law",
    "workplace": "Employment Law",
    "estate & probate": "Estate & Probate",
    "estate": "Estate & Probate",
    "probate": "Estate & Probate",
    "trust": "Estate & Probate",
    "trust administration": "Estate & Probate",
    "will contest": "Estate & Probate",
    "inheritance": "Estate & Probate",
    "administrative law": "Administrative Law",
    "administrative": "Administrative Law",
    "agency": "Administrative Law",
    "business & commercial": "Business & Commercial",
    "business": "Business & Commercial",
    "commercial": "Business & Commercial",
    "insurance law": "Insurance Law",
    "insurance": "Insurance Law",
    "family law": "Family Law",
    "spousal support / maintenance": "Spousal Support / Maintenance",
    "spousal support": "Spousal Support / Maintenance",
    "maintenance": "Spousal Support / Maintenance",
    "alimony": "Spousal Support / Maintenance",
    "child support": "Child Support",
    "parenting plan / custody / visitation": "Parenting Plan / Custody / Visitation",
    "parenting plan": "Parenting Plan / Custody / Visitation",
    "custody": "Parenting Plan / Custody / Visitation",
    "visitation": "Parenting Plan / Custody / Visitation",
    "child custody": "Parenting Plan / Custody / Visitation",
    "property division / debt allocation": "Property Division / Debt Allocation",
    "property division": "Property Division / Debt Allocation",
    "debt allocation": "Property Division / Debt Allocation",
    "asset division": "Property Division / Debt Allocation",
    "attorney fees & costs": "Attorney Fees & Costs",
    "attorney fees": "Attorney Fees & Costs",
    "legal fees": "Attorney Fees & Costs",
    "procedural & evidentiary issues": "Procedural & Evidentiary Issues",
    "procedural": "Procedural & Evidentiary Issues",
    "evidentiary": "Procedural & Evidentiary Issues",
    "jurisdiction & venue": "Jurisdiction & Venue",
    "jurisdiction": "Jurisdiction & Venue",
    "venue": "Jurisdiction & Venue",
    "enforcement & contempt orders": "Enforcement & Contempt Orders",
    "enforcement": "Enforcement & Contempt Orders",
    "contempt": "Enforcement & Contempt Orders",
    "modification orders": "Modification Orders",
    "modification": "Modification Orders",
    "miscellaneous / unclassified": "Miscellaneous / Unclassified",
    "miscellaneous": "Miscellaneous / Unclassified",
    "other": "Miscellaneous / Unclassified",
    "unknown": "Miscellaneous / Unclassified",
    "general": "Miscellaneous / Unclassified",
}


def issue_category(value: Column) -> Column:
    """The category of that name, else of the first name that holds the value or that it holds, else the miscellaneous one."""
    exact = F.create_map(*[F.lit(x) for kv in ISSUE_CATEGORIES.items() for x in kv])

    def found(t: Column) -> Column:
        return F.coalesce(F.try_element_at(exact, t), *[F.when(F.contains(t, F.lit(k)) | F.contains(F.lit(k), t), v) for k, v in ISSUE_CATEGORIES.items()])

    # As an element, so that the value is made lower-case once and not for each name.
    own = F.get(F.transform(F.array(F.lower(F.trim(value))), found), 0)
    return F.coalesce(F.when(value != "", own), F.lit("Miscellaneous / Unclassified"))


#: Canonical categories of the loader. Fixed values.
LOADER_CATEGORIES = {
    "tort": "Tort Law", "tort law": "Tort Law", "torts": "Tort Law",
    "criminal": "Criminal Law", "criminal law": "Criminal Law",
    "civil": "Civil Procedure", "civil law": "Civil Procedure", "civil procedure": "Civil Procedure",
    "constitutional": "Constitutional Law", "constitutional law": "Constitutional Law",
    "administrative": "Administrative Law", "administrative law": "Administrative Law", "admin law": "Administrative Law",
    "family": "Family Law", "family law": "Family Law", "domestic": "Family Law", "domestic relations": "Family Law",
    "property": "Property Law", "property law": "Property Law", "real property": "Property Law", "real estate": "Property Law",
    "contract": "Contract Law", "contract law": "Contract Law", "contracts": "Contract Law",
    "employment": "Employment Law", "employment law": "Employment Law", "labor": "Employment Law", "labor law": "Employment Law",
    "evidence": "Evidence", "evidentiary": "Evidence",
}


def loader_category(value: Column) -> Column:
    """The canonical name, else the trimmed value."""
    return mapped(value, LOADER_CATEGORIES, F.trim(value))


#: Districts by their spellings. Fixed values.
DISTRICTS = {
    "division i": "Division I", "division 1": "Division I", "div i": "Division I", "div. i": "Division I", "i": "Division I",
    "division ii": "Division II", "division 2": "Division II", "div ii": "Division II", "div. ii": "Division II", "ii": "Division II",
    "division iii": "Division III", "division 3": "Division III", "div iii": "Division III", "div. iii": "Division III", "iii": "Division III",
}


def district(value: Column) -> Column:
    """E17."""
    return mapped(value, DISTRICTS, F.lit("N/A"))


def level(value: Column) -> Column:
    """Supreme or Appeals, the default."""
    return F.when(F.lower(value).contains("supreme"), "Supreme").otherwise("Appeals")


def publication(value: Column) -> Column:
    """One of three, Published by default."""
    return _by_words(value, ((("unpublished",), "Unpublished"), (("partial",), "Partially Published")), "Published")


#: Words of which a personal role holds one, and the roles by the words that it holds. Fixed values.
ROLE_WORDS = ("husband", "wife", "parent", "child", "estate", "corporation", "government", "individual", "other", "unknown")
PERSONAL_ROLES = (
    (("husband",), "Husband"),
    (("wife",), "Wife"),
    (("parent",), "Parent"),
    (("child",), "Child"),
    (("estate",), "Estate"),
    (("corporation",), "Corporation"),
    (("company",), "Corporation"),
    (("business",), "Corporation"),
    (("government",), "Government"),
    (("state",), "Government"),
    (("individual",), "Individual"),
    (("person",), "Individual"),
    (("other",), "Other"),
)


def personal_role(value: Column) -> Column:
    """A role, or null where the value is a name or says nothing."""
    return F.when(_has(F.lower(value), *ROLE_WORDS), _by_words(value, PERSONAL_ROLES))


def first_name(values: Column) -> Column:
    """The first of an array of names that isn't blank, trimmed."""
    return F.try_element_at(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))


def file_metadata(name: Column) -> Column:
    """struct(case_number, division) of a file's name: what stands before and after the last underscore of its stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.struct(F.regexp_replace(stem, "_[^_]*$", "").alias("case_number"), F.coalesce(F.nullif(F.regexp_extract(stem, "_([^_]*)$", 1), F.lit("")), F.lit("")).alias("division"))


def metadata_row(row: dict[str, Column]) -> Column:
    """A struct of a metadata row's columns: text trimmed, the year as a number, dates parsed, and the court level of the opinion type."""
    text = ("opinion_type", "publication_status", "month", "case_number", "division", "case_title", "file_contains", "case_info_url", "pdf_url", "pdf_filename", "download_status")
    get = lambda c: F.trim(F.coalesce(row.get(c, F.lit(None).cast("string")), F.lit("")))
    kind = F.lower(get("opinion_type"))
    court = F.when(kind.contains("supreme"), "Supreme Court").when(_has(kind, "appeals", "appellate"), "Court of Appeals").when(kind != "", get("opinion_type")).otherwise("Unknown")
    return F.struct(*[get(c).alias(c) for c in text], get("year").try_cast("int").alias("year"), any_date(get("file_date")).alias("file_date"), court.alias("court_level"))


def brief_document_type(brief_type: Column, party: Column) -> Column:
    """E33."""
    return F.when((brief_type == "Opening") & (party == "Appellant"), "opening_brief").when((brief_type == "Response") & (party == "Respondent"), "respondent_brief").when(brief_type == "Reply", "reply_brief").otherwise("opening_brief")


#: How documents of a type are processed. Fixed values.
STRATEGIES = {
    "appellate_opinion": "case_outcome", "trial_court_order": "case_outcome", "final_judgment": "case_outcome",
    "opening_brief": "brief_extraction", "respondent_brief": "brief_extraction", "reply_brief": "brief_extraction",
    "transcript": "evidence_indexing", "exhibit": "evidence_indexing",
}


def strategy(slug: Column) -> Column:
    """How a document of a type is processed, text_only by default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), slug), F.lit("text_only"))


#: Fixed values.
HOLDINGS = ("affirmed", "reversed", "remanded", "vacated", "harmless_error")


def holding(value: Column) -> Column:
    """A known holding, affirmed by default."""
    return F.when(value.isin(*HOLDINGS), value).otherwise("affirmed")


def title(value: Column) -> Column:
    """Without asterisks, on one line, in title case; null for a blank one, which is an error."""
    return title_case(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(value, r"\*", ""), r"\s+", " ")), F.lit("")))


def person(value: Column) -> Column:
    """A name on one line in title case; null for a blank one, which is an error."""
    return title_case(F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit("")))


#: Spellings that are kept, in order. Fixed values.
PUBLICATIONS = ("Published", "Unpublished", "Partially Published", "Published Only", "Unpublished Only", "Partially Published Only")
LEGAL_ROLES = ("Appellant", "Respondent", "Petitioner", "Third Party", "Appellant/Cross Respondent", "Respondent/Cross Appellant", "Unknown")
PERSONS = ("Husband", "Wife", "Parent", "Child", "Other", "Estate", "Corporation", "Government", "Individual", "Unknown")
REPRESENTED = (
    (("appellant", "cross"), "Appellant"),
    (("respondent", "cross"), "Respondent"),
    (("appellant",), "Appellant"),
    (("respondent",), "Respondent"),
    (("petitioner",), "Petitioner"),
    (("third party",), "Third Party"),
    (("third-party",), "Third Party"),
    (("guardian ad litem",), "Appellant"),
)


def _spelled(value: Column, names: tuple[str, ...]) -> Column:
    return mapped(value, {n.lower(): n for n in names})


def publication_checked(value: Column) -> Column:
    """A known spelling; else by words, in which "published" also stands in "unpublished"; Published by default."""
    tests = ((("published", "only"), "Published"), (("partially", "published"), "Partially Published"), (("published",), "Published"))
    return F.coalesce(_spelled(value, PUBLICATIONS), _by_words(value, tests, "Published"))


def representing(value: Column) -> Column:
    """Whom an attorney represents, Unknown by default."""
    return F.coalesce(_spelled(value, LEGAL_ROLES), _by_words(value, REPRESENTED, "Unknown"))


def legal_role(value: Column) -> Column:
    """Of a role with a cross role the first; known spellings stay, in lower case too; others are Appellant; null and blank stay."""
    t = F.trim(value)
    kept = t.isin(*LEGAL_ROLES, "appellant", "respondent", "petitioner")
    first = _by_words(t, ((("appellant/cross respondent",), "Appellant"), (("respondent/cross appellant",), "Respondent")))
    return F.when(value == "", value).otherwise(F.coalesce(first, F.when(kept, t), F.when(value.isNotNull(), "Appellant")))


def personal_role_checked(value: Column) -> Column:
    """A known spelling, else by words, else Other; words for nothing are null."""
    tests = ((("husband",), "Husband"), (("wife",), "Wife"), (("parent",), "Parent"), (("estate",), "Estate"))
    return F.when(~F.lower(F.trim(value)).isin("", "none", "null"), F.coalesce(_spelled(value, PERSONS), _by_words(value, tests, "Other")))


#: Fixed values.
PARTY_ROLES = {"appellant": "appellant", "respondent": "respondent", "petitioner": "petitioner", "appellee": "respondent", "cross_appellant": "cross_appellant"}
JUDGE_ROLES = {"author": "authoring", "concurring": "concurring", "dissenting": "dissenting", "pro_tempore": "pro_tempore", "author_pro_tempore": "authoring", "concurring_pro_tempore": "concurring"}


def exact_map(value: Column, names: dict[str, str], otherwise: str) -> Column:
    """PARTY_ROLES and JUDGE_ROLES by exact spelling, so that "Respondent" is the default too."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), F.lit(otherwise))


def rule_mode_case(opinion_type: Column, division: Column, case_number: Column, outcome: Column, year: Column, file_contains: Column) -> Column:
    """struct(court_level, division, docket_number, outcome, year, published) of a case loaded by rules."""
    kind, d = F.lower(opinion_type), F.trim(F.coalesce(division, F.lit("")))
    court = F.when(kind.contains("supreme"), "supreme_court").when(kind.contains("appeals"), "court_of_appeals").otherwise("unknown")
    suffix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("1", "I", "2", "II", "3", "III")]), d), F.nullif(d, F.lit("")))
    known = F.when(outcome.isin("affirmed", "reversed", "remanded", "dismissed"), outcome)
    return F.struct(
        court.alias("court_level"), F.concat(F.lit("Division "), suffix).alias("division"), F.concat_ws("-", case_number, suffix).alias("docket_number"), known.alias("outcome"),
        F.trim(year).try_cast("int").alias("year"), (~F.coalesce(F.lower(file_contains).contains("unpublished"), F.lit(False))).alias("published"),
    )


#: Agents by the words of a question, in order. Fixed values.
ROUTES = (
    ("SQL", r"\b(?:who|when|which|outcome|date|party|parties|judge)\b"),
    ("RAG", r"\b(?:why|how (?!many|much|often))"),
    ("SQL", r"\b(?:how many|how much|how often|count|number of|average|percent|percentage|rate|statistics|total)\b"),
    ("RAG", r"\b(?:quote|quotes|context|passage|text|excerpt)\b"),
    ("SQL", r"\b(?:cited|cites|represented|represents|related)\b"),
)


def route(question: Column) -> Column:
    """The agent that answers a question: facts, reasons, statistics, quotes and relations in this order, else retrieval."""
    return F.coalesce(*[F.when(F.lower(question).rlike(p), a) for a, p in ROUTES], F.lit("RAG"))


def court_name(level: Column, division: Column) -> Column:
    """A court's name from its level and division; null for other levels."""
    named = F.trim(F.concat(F.lit("Washington Court of Appeals Division "), F.coalesce(division, F.lit(""))))
    return F.when(F.lower(level).contains("supreme"), "Washington State Supreme Court").when(F.lower(level).contains("appeals"), named)


def docket_number(number: Column, division: Column) -> Column:
    """E30."""
    return F.when(F.coalesce(division, F.lit("")) != "", F.concat(number, F.lit("-"), division)).otherwise(number)


def case_title(title: Column, parties: Column, file: Column) -> Column:
    """The title; else the first appellant and respondent of an array of struct(name, role); else the first party; else the file."""
    first = lambda word: F.try_element_at(F.filter(parties, lambda p: F.lower(p["role"]).contains(word)), F.lit(1))["name"]
    a, r = first("appellant"), first("respondent")
    unknown = F.lit("Unknown")
    sides = F.when(a.isNotNull() | r.isNotNull(), F.concat(F.coalesce(a, unknown), F.lit(" v. "), F.coalesce(r, unknown)))
    return F.coalesce(F.nullif(title, F.lit("")), sides, F.nullif(F.try_element_at(parties, F.lit(1))["name"], F.lit("")), F.nullif(file, F.lit("")), unknown)


#: Stages and document types by the words of an opinion type, in order. Fixed values.
STAGES = ((("supreme court",), "Supreme Court"), (("court of appeals",), "Court Of Appeals"), (("superior court",), "Superior Court"), (("district court",), "District Court"))
DOCUMENT_TYPES = (
    (("supreme court",), "Supreme Court Opinion"),
    (("court of appeals",), "Court of Appeals Opinion"),
    (("majority opinion",), "Majority Opinion"),
    (("concurring opinion",), "Concurring Opinion"),
    (("dissenting opinion",), "Dissenting Opinion"),
    (("court decision",), "Court Decision"),
)


def stage(opinion_type: Column, level: Column) -> Column:
    """M3: the stage that the opinion type names, else that of the court's level; null without either."""
    return F.coalesce(_by_words(opinion_type, STAGES), _by_words(level, ((("supreme",), "Supreme Court"), (("appeal",), "Court Of Appeals"))))


def document_type(opinion_type: Column) -> Column:
    """M3: Court Decision by default."""
    return _by_words(opinion_type, DOCUMENT_TYPES, "Court Decision")
