"""Ring sharding, line dedup, pseudonyms and URL rules against plain versions, with hot keys and defined cases."""

import random
import zlib
from collections import Counter, defaultdict
from datetime import date

import pytest
from llm import plain
from pyspark.sql import functions as F

from ratesift.llm.columns import values
from ratesift.llm.line_dedup import drop_common_lines
from ratesift.llm.pseudonyms import pseudonymise
from ratesift.llm.ring_sharding import fill, shard_rows
from ratesift.llm.url_rules import judge_urls


def test_ring_matches_a_walk_over_single_keys():
    rng = random.Random(2)
    for shards in (1, 3, 8):
        slots = sorted(rng.randrange(500) for _ in range(6 * shards))
        owners = [rng.randrange(shards) for _ in slots]
        owners[:shards] = range(shards)
        keys = sorted([rng.randrange(500) for _ in range(200)] + [77] * 90)
        runs = fill(dict(Counter(keys)), slots, owners, shards)
        place, dealt = defaultdict(int), {}
        for i, slot in enumerate(keys):
            at, place[slot] = place[slot], place[slot] + 1
            (dealt[i],) = [s for run, lo, hi, s, _ in runs if run == slot and lo <= at < hi]
        assert dealt == plain.walked_ring(slots, owners, keys, shards)


def test_shards_are_even_gapless_and_steady(spark):
    rows = [(i, f"text {i % 7} ä") for i in range(3000)] + [(9, "same id")] * 500 + [(None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("own"))
    found = shard_rows(docs, 8).collect()
    assert len(found) == len(rows)
    for shard, n in Counter(r.shard for r in found).items():
        assert n in (len(rows) // 8, len(rows) // 8 + 1)
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    for r in found:
        if r.doc_id == 3:
            assert (r.size, r.text_crc32) == (len("text 3 ä".encode()) + 1, zlib.crc32("text 3 ä".encode()))
        if r.doc_id is None:
            assert (r.size, r.text_crc32) == (1, 0)
    nine = {(r.doc_id, r.text_crc32): r.shard for r in shard_rows(docs.where("doc_id <> 9"), 9).collect()}
    eight = {(r.doc_id, r.text_crc32): r.shard for r in shard_rows(docs.where("doc_id <> 9"), 8).collect()}
    moved = sum(nine[k] != eight[k] for k in eight)
    assert moved < 0.6 * len(eight)  # dealing anew would move eight ninths
    assert shard_rows(docs.where("doc_id = -1")).count() == 0


def test_lines_against_plain_counts(spark):
    rng = random.Random(3)
    common = ["Hot line", "  hot LINE\t", "Ünder", "ünder", "x" * 3000, ""]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.4 else f"own {rng.randrange(900)}" for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts += [None, "", "\n\n", "hot line", *["hot line\nhot line\nonly here"] * 3, "a\n" * 5000 + "hot line"]
    docs = spark.createDataFrame([(i // 2, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    for batches in (1, 5):
        found = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in drop_common_lines(docs, 10, batches).collect())
        assert found == sorted((i // 2, *line) for i, line in enumerate(plain.kept_lines(texts, 10)))
    assert drop_common_lines(docs.where("doc_id < 0")).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "", "block"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"), ("co", "/", "block"), ("x.co", "/x", "allow"), ("y.x.co", "/xy/", "block")]


def test_urls_against_every_rule(spark):
    rng = random.Random(4)
    hosts = ["net", "Example.NET", "b.example.net", "a.example.net", "c.a.example.net", "xexample.net", "example.com", "net.", ".net",
             "user@example.net", "example.net:80", "", "y.x.co", "z.y.x.co", "x.co", "org", "w.org", "a..b"]
    paths = ["", "/", "/en/", "/en", "/EN/a", "/de/x", "/fr/?q=/en/", "#x/en/", "?a://b/", "/x", "/xy/z", "/xy"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(900)]
    urls += [None, "", "no scheme", "http:/x", *["http://b.example.net/en/hot"] * 600]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = values(spark, RULES + [(None, "/", "block"), ("zz", None, "allow")], "host, path, verdict")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules, "allow").collect()}
    assert found == {i: plain.verdict(u, RULES, "allow") for i, u in enumerate(urls)}
    assert judge_urls(pages.where("page_id < 0"), rules).count() == 0


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    texts = {
        1: "Pay 4041894974608795, 4041-8949-7460-8795 or 4041 8949 7460 8795 now", 2: "not 4041894974608796 but 4041894974608795.",
        3: "from 70.123.182.155 and 256.1.1.1", 4: "born 1984-02-29, not 1985-02-29 or 1884-02-28; 3.4.1990 and 03.04.1990 and 12/31/1999",
        5: "call +1 (743) 555-3824 or (743) 555-3824", 6: "write Ab.c9@mail5.example.com. Bye", 7: "nothing here, version 2.0.", 8: None, 9: "",
        10: "x" * 50_000 + " 70.123.182.155 " + "4" * 60_000,
    }
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, names int")
    found = {r.doc_id: r for r in pseudonymise(docs, "key").collect()}
    assert [found[i].n_replaced for i in texts] == [3, 1, 1, 4, 2, 1, 0, 0, 0, 1]
    assert (found[7].text, found[8].text, found[9].text) == (texts[7], None, "")
    plain_, dashed, spaced = found[1].text.replace("Pay ", "").replace(" now", "").replace(" or ", ", ").split(", ")
    assert plain_ == dashed.replace("-", "") == spaced.replace(" ", "") != "4041894974608795" and luhn(plain_) and len(plain_) == 16
    assert found[2].text == f"not 4041894974608796 but {plain_}."
    address = found[3].text.split()[1]
    assert found[3].text.endswith("and 256.1.1.1") and all(0 <= int(o) <= 255 for o in address.split(".")) and address in found[10].text
    parts = found[4].text.replace(";", "").replace(",", "").split()
    assert parts[2:5] == ["not", "1985-02-29", "or"] and date.fromisoformat(parts[1]).year in range(1900, 2100)
    day, month, year = parts[8].split(".")
    assert parts[6].split(".") == [str(int(day)), str(int(month)), year] and len(parts[8]) == 10
    assert found[5].text.startswith("call +1 (") and found[5].text.count("-") == 2
    assert found[6].text.endswith("@mail5.example.com. Bye") and found[6].text != texts[6]
    assert pseudonymise(docs, "other key").where("doc_id = 3").first().text != found[3].text
    assert pseudonymise(docs.where("doc_id < 0"), "key").count() == 0


def test_pseudonyms_of_common_forms(spark):
    texts = {
        1: "25/12/1990", 2: "1990-12-25T10:00:00", 3: "+14155550123", 4: "+1 (415) 555-0123", 5: "(415) 555-0123", 6: "123-45-6789",
        7: "000-45-6789", 8: "666-45-6789", 9: "123-00-6789", 10: "31/02/1990", 11: "12/25/1990", 12: "1990-12-25", 13: "25/13/1990",
        14: "+493012345678", 15: "1990-12-25Tx", 16: "415-555-0123",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in pseudonymise(docs, "key").collect()}
    assert {i for i in texts if found[i].n_replaced == 0} == {7, 8, 9, 10, 13, 15}
    assert all(found[i].text == texts[i] for i in (7, 8, 9, 10, 13, 15))
    day, month, year = map(int, found[1].text.split("/"))
    assert day > 12 and date(year, month, day) and len(found[1].text) == 10
    month, day, year = found[11].text.split("/")
    assert found[12].text == f"{year}-{month}-{day}" and found[2].text == found[12].text + "T10:00:00"
    national = ["".join(c for c in found[i].text if c.isdigit())[-10:] for i in (3, 4, 5, 16)]
    assert len(set(national)) == 1 and national[0] != "4155550123"
    assert found[4].text[:4] == "+1 (" and found[4].text[7:9] == ") " and found[3].text[:2] == "+1" and found[14].text[:3] == "+49"
    area, group, serial = found[6].text.split("-")
    assert 0 < int(area) < 900 and area != "666" and int(group) and int(serial) and (len(area), len(group), len(serial)) == (3, 2, 4)
    assert found[6].kinds == ["security"]


def test_slashed_dates_never_meet(spark):
    days = spark.range(400).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = days.select("doc_id", F.date_format("d", "MM/dd/yyyy").alias("text")).unionByName(
        days.where("dayofmonth(d) > 12").select("doc_id", F.date_format("d", "dd/MM/yyyy").alias("text")))
    out = [r.text for r in pseudonymise(forms, "key").collect()]
    assert len(set(out)) == len(out) > 600


@pytest.mark.parametrize("size", [1, 2, 5])
def test_feistel_permutes(spark, size):
    from ratesift.llm.pseudonyms import permuted_text

    numbers = spark.range(10 ** min(size, 3)).select(F.lpad(F.col("id").cast("string"), size, "0").alias("s"))
    out = [r.p for r in numbers.select(permuted_text(F.col("s"), F.lit("t"), "k").alias("p")).collect()]
    assert len(set(out)) == len(out) and all(len(p) == size and p.isdigit() for p in out)
