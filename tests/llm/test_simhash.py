import hashlib
import random
import re

import xxhash

from tests.llm.conftest import DATA
from veritab.llm import simhash
from veritab.llm.queries import QUERIES


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute(text):
    """Fingerprint by counting votes bit by bit."""
    votes = [0] * 128
    for word in {x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x}:
        weight = min(len(word), simhash.HEAVIEST)
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        # Spark hashes a long like its eight bytes, lowest first.
        h1 = second_hash(h)
        for j in range(64):
            votes[j] += weight if h >> j & 1 else -weight
            votes[64 + j] += weight if h1 >> j & 1 else -weight
    hi = sum(1 << j for j in range(64) if votes[j] > 0)
    lo = sum(1 << j for j in range(64) if votes[64 + j] > 0)
    return f"{hi:016x}{lo:016x}"


def second_hash(h):
    first = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest((1).to_bytes(4, "little"), first)


def test_query_equals_brute_force(spark):
    rows = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, DATA).collect()}
    assert len(got) == len(rows)
    prints = {r.doc_id: brute(r.text) for r in rows}
    alike = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    for r, after in zip(rows, rows[1:] + rows[:1]):
        half = len(r.text) // 2
        changed = r.text[: len(r.text) - half] + after.text[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text)
        assert g.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert g.fingerprint == prints[r.doc_id] and g.edited_fingerprint == brute(changed)
        assert g.near_edited == alike(g.fingerprint, g.edited_fingerprint)
        assert g.near_next == alike(g.fingerprint, prints[after.doc_id])
        near = sum(alike(g.fingerprint, p) >= 1 - simhash.RADIUS / 128 for p in prints.values()) - 1
        assert g.n_near == (near if r.doc_id % 20 == 0 else None)


def test_next_rows_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 5)
    rng = random.Random(2)
    keys = [rng.randrange(60) for _ in range(150)] + [None, None]
    table = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "doc_id long, text string")
    got = simhash.with_next(table, "doc_id", "text").collect()
    order = sorted(((k, f"t{i}") for i, k in enumerate(keys)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = {t: after for (_, t), (_, after) in zip(order, order[1:] + order[:1])}
    assert {r.text: r.next_text for r in got} == want
    place = {(r.range, r.place): r.text for r in got}
    assert {r.text: place[r.next_range, r.next_place] for r in got} == want


def test_odd_and_empty_tables(odd_documents, no_documents, spark):
    got = simhash.with_next(odd_documents, "doc_id", "text")
    assert got.count() == odd_documents.count()
    prints = simhash.fingerprints(got, "text", ["key", "range", "place"]).collect()
    assert len(prints) == odd_documents.count()
    assert simhash.with_next(no_documents, "doc_id", "text").count() == 0
    nameless = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert {r.text: r.next_text for r in simhash.with_next(nameless, "doc_id", "text").collect()} == {"a": "b", "b": ""}


def test_radius_search_misses_nothing(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(128) for _ in range(60)]
    for p in list(prints):
        for bits in (1, 4, 9, 14, 17, 18):
            q = p
            for b in rng.sample(range(128), bits):
                q ^= 1 << b
            prints.append(q)
    table = spark.createDataFrame([(f"{p:032x}",) for p in prints + prints[:5]], "fingerprint string")
    got = {(r.fingerprint, r.near): r["copies"] for r in simhash.within_radius(table, table).collect()}
    want = {
        (f"{p:032x}", f"{q:032x}"): (prints + prints[:5]).count(q)
        for p in set(prints)
        for q in set(prints)
        if bin(p ^ q).count("1") <= simhash.RADIUS
    }
    assert got == want


def test_block_keys_tell_fingerprints_apart(spark):
    """A row is met under its own bits and those flipped, so the search joins few pairs: all had the key 0 before."""
    rng = random.Random(5)
    rows = [tuple(rng.getrandbits(64) - (1 << 63) for _ in range(2)) for _ in range(50)]
    listed = spark.createDataFrame(rows, "hi long, lo long").select(
        simhash.block_keys(0).alias("own"), simhash.block_keys(2).alias("met")
    ).collect()
    assert len({k for r in listed for k in r.own}) > 6 * 45
    assert all(len(set(r.met)) == 1436 and set(r.own) < set(r.met) for r in listed)


def test_no_python_in_the_plan(documents):
    rows = simhash.with_next(documents, "doc_id", "text")
    plan = simhash.fingerprints(rows, "text", ["key", "range", "place"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_recall_of_near_copies(spark):
    """Of the pairs of different texts that share 85 of 100 word triples, nine in ten lie within the radius; strangers don't."""
    documents = spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.where("text IS NOT NULL AND doc_id < 6000").collect()]
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
        sets.append(set(zip(w, w[1:], w[2:])))
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    together = {(a, b) for ids in holders.values() if len(ids) < 50 for a in ids for b in ids if a < b}
    share = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    near = [(a, b) for a, b in together if rows[a][1] != rows[b][1] and share(a, b) >= 0.85]
    known = sorted({i for pair in near for i in pair})
    prints = {i: int(brute(rows[i][1]), 16) for i in known}
    apart = lambda a, b: bin(prints[a] ^ prints[b]).count("1")
    assert len(near) > 100 and sum(apart(a, b) <= simhash.RADIUS for a, b in near) >= 0.9 * len(near)
    close = [(a, b) for a in known for b in known if b < a and apart(a, b) <= simhash.RADIUS]
    assert sum(share(a, b) < 0.3 for a, b in close) <= 0.05 * len(close)
