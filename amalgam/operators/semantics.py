"""What columns mean, and the rules that follow: offline providers behind pluggable interfaces."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from amalgam.plans.rules import normalise

#: Terms of each class of entity, in order of precedence; a term anywhere in the text decides.
ENTITY_TERMS = (
    ("hcp", ("hcp", "provider", "physician", "doctor", "clinician", "practitioner", "nurse", "therapist", "dentist", "pharmacist", "prescriber")),
    ("patient", ("patient", "beneficiary", "enrollee", "insured", "claimant", "recipient")),
    ("location", ("location", "site", "facility", "clinic", "hospital", "practice", "office", "branch", "store", "venue", "address")),
    ("account", ("account", "organization", "organisation", "company", "business", "enterprise", "b2b", "vendor", "supplier", "partner", "employer", "corporate", "firm", "entity", "brand")),
    ("customer", ("customer", "consumer", "individual", "person", "contact", "lead", "prospect", "subscriber", "member", "loyalty", "retail", "b2c")),
)
#: Names of the classes for display.
ENTITY_LABELS = {"hcp": "Healthcare Provider (HCP)", "customer": "Customer / Consumer", "account": "Account / Organization", "patient": "Patient / Member", "location": "Location / Facility", "generic": "Generic Entity"}

#: Parts of column names by what the column means, in order of precedence, with the role in matching.
SEMANTICS = (
    ("system_field", ("created", "updated", "row_id", "batch", "load_"), "not_matchable"),
    ("strong_identifier", ("npi", "ssn", "ein", "duns", "lei", "mrn", "passport", "tax_id", "dea"), "primary_strong"),
    ("scoped_identifier", ("license", "licence", "member_id", "account_number", "loyalty", "customer_id", "plan_id"), "primary_scoped"),
    ("organization_name", ("company", "organization", "organisation", "practice_name", "facility_name", "employer"), "primary_name"),
    ("contact_info", ("email", "mail", "phone", "mobile", "fax", "domain"), "supporting_exact"),
    ("address_component", ("address", "street", "city", "state", "zip", "postal", "county"), "primary_composite"),
    ("demographic", ("gender", "sex", "dob", "birth", "ethnic", "marital"), "supporting_exact"),
    ("person_name", ("first_name", "last_name", "middle_name", "full_name", "suffix", "surname", "fname", "lname"), "primary_name"),
    ("taxonomy_code", ("specialty", "taxonomy", "naics", "icd", "segment", "type", "class"), "supporting_equals"),
    ("credential", ("degree", "credential", "certif"), "supporting_equals"),
    ("free_text", ("note", "comment", "description", "text"), "not_matchable"),
)

SemanticClassifier = Callable[[dict[str, dict], str], dict[str, dict]]
RuleProvider = Callable[[dict[str, dict], dict[str, dict], str], dict]


def entity_class(text: str) -> str:
    said = text.lower().strip()
    return next((name for name, terms in ENTITY_TERMS if any(t in said for t in terms)), "generic")


def entity_class_column(c: Column) -> Column:
    said = F.lower(F.trim(c))
    out = F.lit("generic")
    for name, terms in reversed(ENTITY_TERMS):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(said, F.lit(t))
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(out, F.lit("generic"))


def entity_label(text: str) -> str:
    return ENTITY_LABELS[entity_class(text)]


#: What identifies each class of entity, and which fields can contradict a match.
GUIDES = {
    "hcp": {"identifiers": ("npi", "dea_number", "license_number"), "negative": ("gender", "npi")},
    "customer": {"identifiers": ("ssn", "loyalty_no", "customer_id"), "negative": ("gender", "dob")},
    "account": {"identifiers": ("ein", "duns", "lei"), "negative": ("ein", "duns")},
    "patient": {"identifiers": ("mrn", "medicare_id", "member_id", "ssn"), "negative": ("gender", "dob")},
    "location": {"identifiers": ("npi", "license_no", "fips"), "negative": ("facility_type", "state")},
    "generic": {"identifiers": (), "negative": ()},
}


def inference_guide(text: str) -> dict:
    return GUIDES[entity_class(text)]


def negative_guidance(text: str) -> tuple[str, ...]:
    """Fields that may contradict; of the generic class those of customers."""
    name = entity_class(text)
    return GUIDES["customer" if name == "generic" else name]["negative"]


def classify(profile: dict[str, dict], entity: str = "") -> dict[str, dict]:
    """Offline classifier by column name and profile: semantic type, role, and whether it can lead a rule."""
    out = {}
    for column, facts in profile.items():
        name = column.lower()
        found = next(((kind, role) for kind, parts, role in SEMANTICS if any(p in name for p in parts)), None)
        if found is None:
            found = ("strong_identifier", "primary_strong") if facts.get("is_high_cardinality") and facts.get("is_numeric_string") else ("unknown", "not_matchable")
        out[column] = {"semantic_type": found[0], "match_role": found[1], "can_be_primary": found[1].startswith("primary")}
    return out


#: Parts of column names by the kind of value to clean, for every class of entity and for each.
CLEANING_PARTS = {
    "phone": ("phone", "mobile", "tel", "cell", "fax"),
    "fax": ("fax",),
    "email": ("email", "mail", "e-mail"),
    "date": ("dob", "birth", "date", "enumeration", "created", "updated"),
    "address": ("address", "street", "addr", "line1", "line2"),
    "state": ("state", "province", "region", "license_state", "lic_state"),
    "gender": ("gender", "sex"),
    "first": ("first", "given", "firstname", "fname"),
    "last": ("last", "surname", "lastname", "lname"),
    "middle": ("middle", "middlename", "mname"),
    "org_name": ("practice", "company", "organization", "organisation", "employer", "facility", "hospital", "clinic", "business", "firm"),
}
CLEANING_PARTS_OF = {
    "hcp": {"specialty": ("specialty", "speciality", "spec", "discipline"), "license": ("license", "licence", "lic_num", "licnum", "reg_num")},
    "customer": {"loyalty": ("loyalty", "membership", "member_id", "account_no", "account_number", "customer_id", "client_id")},
    "account": {"industry": ("industry", "sector", "sic", "naics", "vertical"), "company": ("company", "dba", "trade_name", "legal_name", "brand")},
    "patient": {"mrn": ("mrn", "medical_record", "patient_id", "member_id"), "insurance": ("plan", "policy", "group_number", "member_number")},
    "location": {"facility": ("facility", "site", "location", "branch", "store")},
}


def cleaning_hints(entity: str) -> dict[str, tuple[str, ...]]:
    """Kind of value to parts of column names, for this class of entity."""
    return CLEANING_PARTS | CLEANING_PARTS_OF.get(entity_class(entity), {})


def kinds_to_clean(column: str, entity: str) -> list[str]:
    return [kind for kind, parts in cleaning_hints(entity).items() if any(p in column.lower() for p in parts)]


def n_primary(classified: dict[str, dict]) -> int:
    """How many columns can lead a rule."""
    return sum(bool(c.get("can_be_primary")) for c in classified.values())


def analyse(profile: dict[str, dict], entity: str, classifier: SemanticClassifier = classify, cache=None) -> dict[str, dict]:
    """Every column of the profile classified, remembered in a ResultCache if there is one; ValueError without columns."""
    if not profile:
        raise ValueError("the profile has no columns")

    def make() -> dict:
        found = classifier(profile, entity)
        if not isinstance(found, dict):
            raise ValueError("the classifier gave no columns")
        return filled(found, list(profile))

    return cache.get_or(["semantics", getattr(classifier, "__name__", ""), entity, profile], make) if cache is not None else make()


def generate_rules(semantics: dict[str, dict], profile: dict[str, dict], entity: str, provider: RuleProvider | None = None, evidence: dict | None = None, cache=None) -> dict:
    """A normalised rule document from a provider, remembered in a ResultCache if there is one; evidence is optional."""
    provider = provider or propose_rules

    def make() -> dict:
        return normalise(provider(semantics, profile, entity, evidence) if evidence else provider(semantics, profile, entity), entity)

    return cache.get_or(["rules", getattr(provider, "__name__", ""), entity, semantics, profile, evidence or {}], make) if cache is not None else make()


def prompt(task: str, entity: str, **facts) -> str:
    """What a language model is told, if one is plugged in as classifier, rule provider or adjudicator."""
    asked = {
        "semantics": "For each column give semantic_type, match_role and can_be_primary. Reply with one JSON object by column name.",
        "rules": "Propose match rules. Reply with one JSON object that holds a list matchGroups.",
        "evidence": "Propose match rules that follow the evidence first and the column roles second. Reply with one JSON object that holds a list matchGroups.",
        "verdict": "Do the two records describe one entity? Reply with one JSON object: verdict (MATCH, SUSPECT or NO_MATCH), confidence, reasoning.",
    }
    lines = [f"Entity: {entity} ({entity_label(entity)})", *[f"{name}: {json.dumps(value, sort_keys=True, default=str)}" for name, value in facts.items()]]
    return "\n".join([*lines, asked[task]])


def filled(classified: dict[str, dict], expected: list[str]) -> dict[str, dict]:
    """Columns that a classifier passed over become unknown."""
    blank = {"semantic_type": "unknown", "match_role": "not_matchable", "can_be_primary": False}
    return {**classified, **{c: dict(blank) for c in expected if c not in classified}}


#: From which frequency on a column in the evidence leads a rule, supports one, or may be missing in one.
LEADS, SUPPORTS, TOLERATED = 0.85, 0.5, 0.25


def propose_rules(semantics: dict[str, dict], profile: dict[str, dict], entity: str, evidence: dict[str, float] | None = None) -> dict:
    """Offline rule provider: at most eight groups after the roles, and after evidence where there is some.

    Evidence from a half on overrides a column's role: columns that lead get a rule each, columns that support get
    one together if there are two, and weaker ones join these rules as null-tolerant columns at most.

    Strong identifiers match automatically; scoped ones, names and whole addresses make suspects; soft
    attributes weigh in only if nothing else is there; stable codes that are mostly present contradict.
    """
    evidence = evidence or {}
    root = f"configuration/entityTypes/{entity.replace(' ', '')}"
    attribute = lambda c: f"{root}/attributes/{c}"
    of = lambda kind: [c for c, s in semantics.items() if s["semantic_type"] == kind]
    groups, used = [], set()

    def add(name: str, kind: str, exact=(), fuzzy=(), loose=()):
        key = (tuple(exact), tuple(fuzzy))
        if key in used or not (exact or fuzzy):
            return
        used.add(key)
        clause = {k: [attribute(c) for c in cs] for k, cs in (("exact", exact), ("fuzzy", fuzzy), ("exactOrNull", loose)) if cs}
        groups.append({"uri": f"{root}/matchGroups/MatchOn{name}", "label": f"Match on {name}", "type": kind, "scope": "ALL", "useOvOnly": "true", "scoreStandalone": 0, "scoreIncremental": 0, "rule": {"and": clause}})

    for c in of("strong_identifier"):
        add(c.title().replace("_", ""), "automatic", [c])
    scopes = [c for c in semantics if "state" in c.lower()]
    for c in of("scoped_identifier"):
        if c not in scopes:
            add(c.title().replace("_", ""), "suspect", [c, *[s for s in scopes if s.split("_")[0] == c.split("_")[0]][:1]])
    names = {part: next((c for c in of("person_name") if part in c.lower()), None) for part in ("last", "first", "middle")}
    birth = next((c for c in of("demographic") if "dob" in c.lower() or "birth" in c.lower()), None)
    if names["last"] and names["first"]:
        add("Name", "suspect", [names["last"]], [names["first"]], [c for c in (birth, names["middle"]) if c])
    for c in of("organization_name"):
        add(c.title().replace("_", ""), "suspect", (), [c])
    address = of("address_component")
    street = next((c for c in address if "address" in c.lower() or "street" in c.lower()), None)
    city = next((c for c in address if "city" in c.lower()), None)
    region = next((c for c in address if "state" in c.lower() or "zip" in c.lower()), None)
    if street and city and region:
        add("Address", "suspect", [street, city, region])
    band = lambda lo, hi: [c for c, share in evidence.items() if c in semantics and lo <= share < hi]
    weak = band(TOLERATED, SUPPORTS)[:2]
    for c in band(LEADS, 2.0):
        add(f"Evidence{c.title().replace('_', '')}", "suspect", [c], (), weak)
    support = band(SUPPORTS, LEADS)[:3]
    if len(support) >= 2:
        add("EvidenceTogether", "suspect", support, (), weak)
    soft = [c for c, s in semantics.items() if s["match_role"].startswith("supporting")]
    if not groups and len(soft) >= 4:
        groups.append({"uri": f"{root}/matchGroups/MatchOnRelevance", "label": "Match on relevance", "type": "relevance_based", "scope": "ALL", "useOvOnly": "true", "scoreStandalone": 0, "scoreIncremental": 0, "rule": {"weights": [{"attribute": attribute(c), "weight": 1.0 / len(soft)} for c in soft]}})
    stable = [c for c in negative_guidance(entity) if c in profile and profile[c].get("p_missing", 1) < 0.3]
    groups = groups[:8]
    if stable:
        groups.append({"uri": f"{root}/matchGroups/NegativeRuleOn{stable[0].title()}", "label": f"Negative Rule - {stable[0]}", "scope": "ALL", "negativeRule": {"and": {"notExactSame": [attribute(c) for c in stable]}}})
    return {"matchGroups": groups}
