from pyspark.sql import functions as F

from kinline.functions.text import basic_clean, canonical_address, normalise_source, strip_accents, strip_domain, strip_legal_suffix
from kinline.functions.wordlists import LEGAL_SUFFIXES

CLEAN = {
    "QUARTZ Harbour": "quartz harbour", "tiDe&MiLL": "tide mill", "Kestrel;;Yard--(East)": "kestrel yard east", "Lime / Ash #7": "lime ash 7", "  z \t y\n\nx ": "z y x",
    "Unit 9C; Dock-Rd. 4/11": "unit 9c dock rd 4 11", "": "", "\t": "", "007": "007", "6.25": "6 25", None: "", "under_score": "under_score", "ता": "त",
}
SUFFIX = {f"heron {form}": "heron" for form in LEGAL_SUFFIXES} | {
    "heron works llc inc": "heron works", "heron inc ltd co llc": "heron inc", "limited heron": "limited heron", "plc mining sa": "plc mining", "heron Ltd": "heron",
    "kk": "kk", "x gmbh": "x gmbh", "co ltd": "co", "heron": "heron", "  heron  yard ": "  heron  yard ", "": "",
}


def _map(spark, function, given):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    return [r.y for r in rows.select("i", function("x").alias("y")).orderBy("i").collect()]


def test_accents(spark):
    assert _map(spark, strip_accents, ["Żółw Čtyři", "crème brûlée", "Ñandú", "ﬂ ㎏", None]) == ["Zołw Ctyri", "creme brulee", "Nandu", "fl kg", ""]


def test_clean(spark):
    assert _map(spark, basic_clean, CLEAN) == list(CLEAN.values())


def test_suffix(spark):
    assert _map(spark, strip_legal_suffix, SUFFIX) == list(SUFFIX.values())


def test_legal_forms_are_no_describing_words():
    from kinline.functions.wordlists import NAME_STOPWORDS_V1

    assert not set(LEGAL_SUFFIXES) & {*NAME_STOPWORDS_V1} - {"company"}


def test_series(spark):
    names = {"Grüne Mühle GmbH": "grune muhle", "Dock & Quay Pvt. Ltd.": "dock quay", None: "", "Tern Fisheries": "tern fisheries", "S.A.": "s a", "Loom-Works, Co Ltd, Inc": "loom works"}
    df = spark.createDataFrame([(str(i), n, None, None) for i, n in enumerate(names)], "entity_id string, business_name string, business_address string, country string")
    rows = normalise_source(df).orderBy("entity_id").collect()
    assert [r.name_clean_legal for r in rows] == list(names.values())
    assert {r.address_norm for r in rows} == {r.country_norm for r in rows} == {""}


def test_domain_and_address(spark):
    assert _map(spark, strip_domain, ["https://www.acme com", "www.x co in", "acme", None]) == ["acme", "x", "acme", ""]
    assert _map(spark, canonical_address, ["12 main st", "1st ave", "22nd blk", ""]) == ["12 main street", "1 avenue", "22 block", ""]


def test_native_only_keys(spark):
    from kinline.functions import keys as k

    df = spark.createDataFrame([("1", "xavier schmidt", "xavier schmidt", "12 rose lane 90210", "us")], "entity_id string, name_norm string, name_clean_legal string, address_norm string, country_norm string")
    r = df.select(k.phonetic_joined().alias("p"), k.longest_pairs().alias("l"), k.postal_and_name3().alias("z"), F.array_join(k.sorted_tokens(), "").alias("s")).first()
    assert (r.p, r.l, r.z, r.s) == (["XFR|SKMT"], ["schmidt|xavier"], ["90210|xav"], "schmidt xavier")
