from sparkloom.plans.cleaning import default_plan, index_mapping
from sparkloom.plans.fuse import Evidence, decide
from sparkloom.plans.names import levenshtein, match_name, name_score, ontology_from, token_ratio
from sparkloom.schemas import Impute, Outlier
from sparkloom.schemas import SemanticType as T


def test_names():
    for name, kind, least in (
        ("mob_number", T.PHONE_PAKISTAN, 0.6), ("shanakhti_card", T.CNIC_PAKISTAN, 0.9), ("d_o_b", T.DATE, 0.9), ("duration", T.DURATION, 0.9),
        ("Patient Age", T.AGE, 0.9), ("user-email", T.EMAIL, 0.85), ("shipping_city", T.CITY, 0.85), ("WhatsApp", T.PHONE_PAKISTAN, 0.9), ("contact no", T.PHONE_PAKISTAN, 0.9), ("fname", T.NAME_PERSON, 0.9),
    ):
        found, score = match_name(name)[0]
        assert (found, score >= least) == (kind, True), name
    assert match_name("qqqqqqq") == [(T.UNKNOWN, 0.0)]
    # A name without letters is contained in everything; the first type comes first.
    assert match_name("نام")[0] == (T.PHONE_PAKISTAN, 0.85)


def test_an_ontology_is_a_table(spark):
    table = spark.createDataFrame([("city", "qasba"), ("city", "gaon"), ("age", "baras")], "type string, synonym string")
    words = ontology_from(table)
    assert words == {T.CITY: ("gaon", "qasba"), T.AGE: ("baras",)} and match_name("home_gaon", words)[0] == (T.CITY, 0.85)


def test_scores():
    assert levenshtein("kitten", "sitting") == 3
    assert name_score("ip", "shipping") == 0.85
    assert name_score("abcdefghi", "abcdefghij") == 0.9
    assert token_ratio("b a", "a b") == 1.0


def evidence(ratios, named=T.UNKNOWN, score=0.0, text=True, distinct=1000, rows=1000, **more):
    return Evidence(ratios, named, score, text, distinct, rows, **more)


def test_rules_in_order():
    cases = [
        (evidence({T.PHONE_PAKISTAN: 1.0, T.EMAIL: 0.9}, T.PHONE_PAKISTAN, 1.0), T.PHONE_PAKISTAN, 1.0),
        (evidence({T.PHONE_PAKISTAN: 0.5}), T.PHONE_PAKISTAN, 0.65),
        (evidence({T.EMAIL: 0.4}, T.EMAIL, 0.5), T.EMAIL, 0.53),
        (evidence({T.DURATION: 0.5, T.TIME: 0.5}), T.TIME, 0.65),
        (evidence({}, T.DURATION, 1.0), T.DURATION, 0.55),
        (evidence({T.DATETIME: 0.4}, T.DATE, 0.9), T.DATE, 0.7),
        (evidence({T.AGE: 0.2}, T.AGE, 0.5, low=1.0, high=90.0), T.AGE, 0.95),
        (evidence({}, T.CURRENCY_AMOUNT, 0.7), T.CURRENCY_AMOUNT, 0.55),
        (evidence({T.PERCENTAGE: 0.5}), T.PERCENTAGE, 0.90),
        (evidence({T.IP_ADDRESS: 0.6}), T.IP_ADDRESS, 0.95),
        (evidence({T.BOOLEAN: 1.0}, distinct=2), T.BOOLEAN, 0.95),
        (evidence({T.BOOLEAN: 1.0}, distinct=7), T.CATEGORICAL, 0.85),
        (evidence({}, distinct=40, rows=1000), T.CATEGORICAL, 0.85),
        (evidence({}, mean_length=100.0), T.TEXT_LONG, 0.85),
        (evidence({T.NUMERIC_INTEGER: 0.9}, T.IDENTIFIER_ID, 0.9, text=False), T.IDENTIFIER_ID, 0.90),
        (evidence({T.NUMERIC_INTEGER: 0.4, T.NUMERIC_FLOAT: 0.5}, text=False), T.NUMERIC_FLOAT, 0.85),
        (evidence({}, T.CITY, 0.8), T.CITY, 0.8),
        (evidence({}), T.TEXT_GENERIC, 0.60),
        (evidence({}, text=False), T.UNKNOWN, 0.40),
    ]
    for e, kind, confidence in cases:
        found, got, _ = decide(e)
        assert (found, round(got, 3)) == (kind, confidence)


def test_default_plan_and_mapping():
    plan = default_plan({"a": T.AGE, "b": T.CITY, "c": T.DATE, "d": T.EMAIL, "e": T.TIME})
    assert [(p.impute, p.outlier) for p in plan.columns.values()] == [
        (Impute.MEDIAN, Outlier.CLIP_IQR), (Impute.MODE, Outlier.NONE), (Impute.FORWARD_FILL, Outlier.NONE), (Impute.CONSTANT, Outlier.NONE), (Impute.CONSTANT, Outlier.NONE),
    ]
    fields = index_mapping({"p": T.PHONE_PAKISTAN, "t": T.DATETIME, "c": T.CURRENCY_AMOUNT, "a": T.AGE, "k": T.CITY})["mappings"]["properties"]
    assert [f["type"] for f in fields.values()] == ["text", "date", "double", "long", "keyword"]
    assert fields["p"]["fields"]["keyword"]["ignore_above"] == 256
