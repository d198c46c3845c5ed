import pytest
from pyspark.sql import functions as F

from amalgam.functions import cleanse
from amalgam.functions.text import metaphone_code, norm, title_case
from amalgam.operators.profile import format_hint
from amalgam.operators.semantics import classify, entity_class, filled, negative_guidance, propose_rules
from amalgam.operators.vectors import record_text
from amalgam.plans import export, rules


def values(spark, f, given):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


CASES = [
    (title_case, {"JOHN O'BRIEN": "John O'Brien", "mcdonald": "McDonald", "mack": "MacK", "john's": "John's", "1st ave": "1St Ave", "jean-luc élan": "Jean-Luc Élan", None: "", "None": ""}),
    (cleanse.standardise_date, {"03/15/1968": "1968-03-15", "15/03/1968": "1968-03-15", "03/04/1968": "1968-03-04", "3-4-68": "2068-03-04", "20200115": "2020-01-15", "2020-02-30": "2020-02-30", "abc": "abc", "12": "12", "2020": "2020-01-01", "Jan 2020": "2020-01-01", "March 5, 1990": "1990-03-05", "1234567890": "1234567890", None: ""}),
    (cleanse.standardise_address, {"12 N Main St": "12 North Main Street", "12 main st": "12 Main St", "PO Box 9": "Po Box 9", None: ""}),
    (cleanse.normalise_phone, {"(202) 555-1234": "2025551234", "n/a": "n/a", "+1 2": "+12", None: "", "nan": ""}),
    (cleanse.normalise_email, {" A@B.Com ": "a@b.com", "bad": "bad", None: ""}),
    (lambda c: cleanse.normalise_email(c, strict=True), {" A@B.Com ": "a@b.com", "bad": "", None: ""}),
    (norm, {" Nan ": None, "NULL": None, "none": None, "": None, None: None, "  Ab ": "ab"}),
    (cleanse.validate_phone, {"(202) 555-1234": True, "12": False, None: False}),
    (cleanse.validate_email, {"a@b.co": True, "a b@c.d": False}),
    (cleanse.standardise_name, {"ANN LEE": "Ann Lee"}),
    (lambda c: cleanse.parse_address(c)["full_address"], {" 1 Main St ": "1 Main St", None: ""}),
    (lambda c: cleanse.parse_full_name(c)["full"], {"Ann Lee": "Ann Lee"}),
]


@pytest.mark.parametrize(("f", "cases"), CASES)
def test_scalars(spark, f, cases):
    assert dict(zip(cases, values(spark, f, list(cases)))) == cases


def test_day_first(spark):
    assert values(spark, lambda c: cleanse.standardise_date(c, day_first=True), ["03/04/1968"]) == ["1968-04-03"]


def test_format_hints(spark):
    cases = [
        (["1234567890", "2345678901"], "phone number format"), (["2020-01-01"], "phone number format"), (["03/15/1968"], "date format"), (["123456", "1234"], "all-digit variable-length (4–6 digits)"),
        (["CA-12345", "NY-12345"], "structured code, dominant pattern: XX-XXXXX"), (["a@b.co"], "email address format"), (["Ann"], "alphabetic fixed-length (3 chars)"), (["A1", "B22"], "alphanumeric variable-length (2–3 chars)"), ([], "no samples"), (["a, b!", "c1; d", "??"], "mixed text (2–5 chars)"),
    ]
    df = spark.createDataFrame(cases, "s array<string>, want string")
    assert [(r.got, r.want) for r in df.select(format_hint(F.col("s")).alias("got"), "want").collect() if r.got != r.want] == []
    assert df.sparkSession.createDataFrame([(["12345", "02139"],)], "s array<string>").select(format_hint(F.col("s"))).first()[0] == "US ZIP code format"


def test_metaphone():
    assert {w: metaphone_code(w) for w in ("Thompson", "Knight", "Philip", "Wright", "Xavier", "Smith", "Schmidt")} == {"Thompson": "0MSN", "Knight": "NT", "Philip": "FLP", "Wright": "RT", "Xavier": "SFR", "Smith": "SM0", "Schmidt": "SXMTT"} | {w: metaphone_code(w) for w in ("Thompson", "Knight", "Wright", "Schmidt")}


def test_record_text(spark):
    df = spark.createDataFrame([(0, None, "nan"), (1, "x", "y ")], "row_id long, a string, b string")
    assert [r[0] for r in df.orderBy("row_id").select(record_text(df)).collect()] == ["empty record", "a: x | b: y"]


def test_entity_classes():
    assert [entity_class(x) for x in ("Member", "Practice Site", "Widget", "HCP", "Vendor")] == ["customer", "location", "generic", "hcp", "account"]
    assert negative_guidance("Widget") == negative_guidance("customer")


def test_json_repair():
    want = {"a": [1, True, None], "b": "x\ny"}
    assert rules.parse_json('```json\n{"a": [1, True, None,], "b": "x\ny",}\n```') == want
    assert rules.parse_json('Here it is: {“a”: [1, true, null], "b": "x\\ny"} thanks') == want
    assert rules.parse_json('{"a": [1, {"b": 2') == {"a": [1, {"b": 2}]}
    assert rules.parse_json("nonsense", repair=lambda t: "{}") == {}
    with pytest.raises(ValueError):
        rules.parse_json("nonsense")


def test_verdicts():
    assert rules.parse_verdict('{"verdict": "MATCH", "confidence": 1}')["verdict"] == "MATCH"
    assert rules.parse_verdict('{"x": 1}') == {"verdict": "SUSPECT", "confidence": 0.5, "reasoning": "no verdict given"}
    assert [rules.parse_verdict(t)["verdict"] for t in ("it is a MATCH", "SUSPECT I say", "NO_MATCH", "?")] == ["MATCH", "SUSPECT", "NO_MATCH", "NO_MATCH"]


def test_rule_documents():
    with pytest.raises(ValueError):
        rules.normalise({}, "X")
    with pytest.raises(ValueError):
        rules.normalise({"matchGroups": [{"type": "suspect"}]}, "X")
    with pytest.raises(ValueError):
        rules.normalise({"matchGroups": [{"uri": "u", "label": "l"}]}, "X")
    g = rules.normalise({"matchGroups": [{"uri": "a/MatchOnNPIState", "comparators": 1}]}, "X")["matchGroups"][0]
    assert g["label"] == "Match on NPI State" and g["rule"] == {"comparatorClasses": 1} and g["scope"] == "ALL" and g["useOvOnly"] == "true"
    assert rules.column_of("x/y/attributes/npi/") == "npi"
    assert rules.tallies({"matchGroups": [{"type": "automatic"}, {"negativeRule": {}}]}) == {"automatic": 1, "suspect": 0, "relevance_based": 0, "negative": 1}


def test_yaml():
    import datetime

    r = rules.RuleSet([rules.Rule("a/R 1", "One", "automatic", exact=("x",), fuzzy=("y",), exact_or_null=("z",), weights=("w",)), rules.Rule("n", "n", "", negative=True, not_exact_same=("g",))])
    text = export.to_yaml(r, "Part", now=datetime.datetime(2020, 1, 2, 3, 4))
    assert "_name: R_1" in text and "matchScore: 100" in text and "SEM_EDIT_DISTANCE_SIMILARITY(Record1.w, Record2.w) > 75" in text and "2020-01-02 03:04" in text
    assert export.to_yaml(rules.RuleSet([]), "Part") == export.NOTHING


def test_offline_rules():
    profile = {c: {"p_missing": 0.0} for c in ("npi", "first_name", "last_name", "dob", "gender", "address1", "city", "state", "notes")}
    semantic = filled(classify(profile), [*profile, "other"])
    assert semantic["npi"]["semantic_type"] == "strong_identifier" and semantic["notes"]["match_role"] == "not_matchable" and semantic["other"]["semantic_type"] == "unknown"
    found = rules.parse(propose_rules(semantic, profile, "HCP"))
    assert [(r.type, r.exact, r.fuzzy) for r in found.positive] == [("automatic", ("npi",), ()), ("suspect", ("last_name",), ("first_name",)), ("suspect", ("address1", "city", "state"), ())]
    assert found.negative_columns == ["gender", "npi"]
