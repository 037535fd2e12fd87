"""Normalisation, address parsing and similarities against hand-made vectors."""

import itertools
import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.functions import similarity as S
from affinis.functions import text as T
from affinis.operators import profile as P

RECORD = "entity_id string, business_name string, business_address string, country string"


def each(spark, f, cases):
    """Applies a column function to all inputs at once and compares with what is expected."""
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", f(F.col("x")).alias("y"))
    assert {cases[r.i][0]: r.y for r in rows.collect()} == dict(cases)


def test_normalise(spark):
    cases = [
        (None, ""), ("", ""), ("  Café  Zürich ", "cafe zurich"), ("A&B/C", "a and b c"), ("Straße", "strasse"), ("Łódź Øl", "lodz ol"), ("x--y__z", "x y z"),
        ("e\u0301te\u0301", "ete"), ("МОСКВА", "moskva"),
    ]
    each(spark, T.normalise, cases)


def test_other_scripts(spark):
    cases = [
        ("Привет & Щука", "privet and shchuka"), ("Объект", "obekt"), ("Київ", "kiiv"), ("йод и\u0306од Ё", "iod iod io"), ("Юля Цех Жук", "iulia tsekh zhuk"),
        ("ΑΘΗΝΑ Ψυχή", "athena psukhe"), ("दिल्ली", "dilli"), ("भारत १२", "bhart 12"), ("मैसूर", "maisur"), ("ঢাকা", "dhaka"), ("ತುಮಕೂರು", "tumkuru"),
        ("東京", ""), ("Acme Москва Ltd", "acme moskva ltd"),
    ]
    each(spark, T.normalise, cases)
    each(spark, T.soundex, [("Москва", "M210"), ("Александр", "A425"), ("Aleksandr", "A425")])


def test_name_variants(spark):
    cases = [
        ("Acme Private Limited", ["acme"]), ("Acme Ltd Inc LLC", ["acme"]), ("Ltd", []), ("", []), (None, []), ("Foo Intl doing business as Bar Mfg Pvt Ltd", ["foo international", "bar manufacturing"]),
        ("dba", ["dba"]), ("dba Blue", ["blue"]), ("One T A Two DBA Three", ["one", "two dba three"]), ("Data Bank", ["data bank"]),
    ]
    each(spark, T.name_variants, cases)
    plain = T.Normalisation(strip_suffixes=False, split_aliases=False)
    each(spark, lambda c: T.name_variants(c, plain), [("Foo dba Bar Inc", ["foo dba bar inc"])])


def test_soundex(spark):
    each(spark, T.soundex, [("Robert", "R163"), ("Rupert", "R163"), ("Tymczak", "T522"), ("Ashcraft", "A261"), ("Ashcroft", "A261"), ("", ""), ("123", "")])


def test_country(spark):
    each(spark, T.normalise_country, [("USA", "us"), ("In", "india"), ("République", "republique"), (None, ""), ("United States of America", "us")])


def test_address(spark):
    cases = [
        ("12 Main St, Boston, MA 02101", "US", "city_words", ["boston"]), ("12 Main St, Boston, MA 02101", "US", "state_words", ["massachusetts"]),
        ("5 Rue X, 75001 Paris", "France", "city_words", ["paris"]), ("5 Rue X, Berlin, 10115", "Germany", "city_words", ["berlin"]), ("one line", "", "city_words", []),
        ("1 A Rd, St Louis, MO 63101", "us", "city_words", ["saint", "louis"]), ("3 N St, Miami, FL 33101", "us", "state_words", []), ("348th Avenue", "", "house_number", "34"), ("1st Street", "", "house_number", ""),
        ("12B High St", "", "house_suffix", "b"), ("Flat no 7, 2 X Rd", "", "units", ["7"]), ("Near City Mall, 9 X Rd", "", "landmarks", ["city", "mall"]), ("+1 (617) 555-0100 ext", "", "phones", ["16175550100"]),
        ("11169 Lake Dr", "", "postals", ["11169"]), ("", "", "layout", "c0|pnone|onone|n0|hnone|fempty"), (None, None, "address_words", []),
        ("12 Main St, Boston, MA 02101", "US", "layout", "c3|plast|otext_before|n1|hfirst|fnumber_first"),
    ]
    rows = spark.createDataFrame([(str(i), "n", a, c) for i, (a, c, _, _) in enumerate(cases)], RECORD)
    for r in P.profile(rows).collect():
        _, _, field, value = cases[int(r.entity_id)]
        assert (sorted(r[field]) if field == "landmarks" else r[field]) == value, cases[int(r.entity_id)]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_indel_ratio_is_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        expected = 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
        assert S.indel_ratio(a, b) == pytest.approx(expected)


def test_jaro_winkler_known_values():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert S.jaro_winkler("", "x") == S.jaro_winkler("abc", "xyz") == 0.0


def test_order_similarity():
    assert S.order_similarity(["a", "b"], ["b", "a"]) == SequenceMatcher(None, ["a", "b"], ["b", "a"]).ratio()
    assert S.order_similarity([], ["a"]) == 0.0


def test_set_similarities_of_nothing_are_zero(spark):
    row = spark.sql("SELECT array('a', 'b') AS a, cast(array() AS array<string>) AS e, array('b', 'c', 'c') AS b")
    got = row.select(S.jaccard(F.col("a"), F.col("e")), S.containment(F.col("a"), F.col("e")), S.jaccard(F.col("a"), F.col("b")), S.containment(F.col("a"), F.col("b"))).first()
    assert list(got) == [0.0, 0.0, pytest.approx(1 / 3), 0.5]


def test_ngrams_sampled_evenly(spark):
    each(spark, lambda c: T.name_ngrams(T.name_variants(c), 3), [("abcdefghij", ["abc", "def", "hij"]), ("ab", ["ab"])])
    each(spark, lambda c: F.size(T.name_ngrams(T.name_variants(c), 0)), [("abcdefghij", 8)])


def test_addresses_of_a_batch_are_compared_together(monkeypatch):
    """The same ratios as one by one, for texts around 64 characters and any script, and without a search for each pair."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc de 12é漢😀") for _ in range(rng.choice([0, 1, 5, 40, 63, 64]))) for _ in range(400)]
    longer = ["".join(rng.choice("abc 12") for _ in range(rng.choice([60, 65, 66, 130]))) for _ in range(100)]
    pairs = [(a, rng.choice(texts)) for a in texts] + [(a, rng.choice((a, *longer, *texts))) for a in longer]
    a, b = zip(*pairs, strict=True)
    one_by_one = [S.indel_ratio(x, y) for x, y in pairs]
    for masks in (S.MASKS, 50):
        monkeypatch.setattr(S, "MASKS", masks)
        assert S.indel_ratios(a, b) == one_by_one
    calls = []
    monkeypatch.setattr(S, "indel_ratio", lambda *pair: calls.append(pair))
    names = pa.array([["same name"]] * 400)
    monkeypatch.setattr(S, "_name_edits", lambda va, vb: (0.0,) * 7)
    (found,) = S._edits(iter([(names, names, pa.array(a[:400]), pa.array(b[:400]))]))
    assert found.field("address_char").to_pylist() == one_by_one[:400] and not calls
    assert S.gram_similarities("ab", "ab") == (1.0, 1.0) and S.gram_similarities("", "ab") == (0.0, 0.0) and S.gram_similarities("a bcd", "abce")[0] == 1 / 3
