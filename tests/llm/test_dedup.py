import hashlib
import random

import numpy as np
import pytest
import xxhash

from catalore.llm import exact_dedup, simhash
from catalore.llm.common import documents
from catalore.llm.components import components

from .conftest import ODD


def exact(rows):
    """(doc_id, keep_id, group_size, digest) by brute force."""
    same = {}
    for doc_id, text in rows:
        plain = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        same.setdefault(plain, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    found = []
    for plain, group in same.items():
        digest = hashlib.sha256(plain.encode()).hexdigest()
        keep = min(group)[3]
        found += [(g[3], keep, len(group), digest) for g in group]
    return sorted(found, key=repr)


@pytest.mark.parametrize("most_slots", [exact_dedup.MOST_SLOTS, 64])
def test_exact_copies_of_odd_rows(odd, most_slots):
    got = exact_dedup.exact_copies(odd, most_slots).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == exact(ODD)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("most_slots", [exact_dedup.MOST_SLOTS, 1024])
def test_exact_copies_over_ranges(spark, sf, most_slots):
    docs = documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact_dedup.exact_copies(docs, most_slots).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == exact(rows)


@pytest.mark.parametrize("most_slots", [exact_dedup.MOST_SLOTS, 64])
def test_drop_copies_keeps_one_row_of_each(clashing, most_slots):
    kept = exact_dedup.drop_copies(clashing, most_slots)
    assert kept.schema.names == clashing.schema.names
    want = {(keep, digest) for _, keep, _, digest in exact(ODD)}
    got = [(r.doc_id, hashlib.sha256("".join((r.text or "").translate({9: "", 10: "", 11: "", 12: "", 13: "", 32: ""})).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert kept.first()["digest"] == "digest"


def test_a_hot_group_of_copies(spark, table):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_copies(table(rows)).collect()
    assert [r.doc_id for r in got if r.group_size > 1 and r.kept] == [0]
    assert sum(r.group_size == 1000 for r in got) == 1000


def test_filter_never_misses_a_repeated_hash(spark):
    random.seed(1)
    hashes = [random.getrandbits(63) for _ in range(500)]
    hashes += hashes[:50]
    keys = spark.createDataFrame([(h,) for h in hashes], "hash long").repartition(5)
    plane = exact_dedup.plane(keys, 4096)
    flagged = exact_dedup.with_flag(keys, plane, 4096, "maybe").filter("maybe").collect()
    assert set(hashes[:50]) <= {r.hash for r in flagged}
    assert len({r.hash for r in flagged}) < 200


def brute_fingerprint(text):
    words = []
    for part in (text or "").encode().lower().split():
        words.append(part.decode())
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else []
    grams = grams or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Component numbers of fingerprints by comparing all pairs."""
    values = sorted(set(prints))
    array, of = np.array(values, np.uint64), list(range(len(values)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array) <= 3):
            a, b = top(i), top(int(j))
            of[max(a, b)] = min(a, b)
    return {v: top(i) for i, v in enumerate(values)}


def check_near(docs, rows):
    prints = [brute_fingerprint(text) for _, text in rows]
    of = brute_components(prints)
    least = {}
    for (doc_id, _), value in zip(rows, prints):
        if doc_id is not None:
            least[of[value]] = min(doc_id, least.get(of[value], doc_id))
    want = sorted(((d, f"{p:016x}", least.get(of[p])) for (d, _), p in zip(rows, prints)), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(docs).collect()), key=repr)
    assert got == want


def test_simhash_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    check_near(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_of_odd_rows(odd):
    check_near(odd, ODD)


def test_near_copies_of_a_text(table):
    random.seed(4)
    words = [f"w{random.randrange(500)}" for _ in range(600)]
    rows = [(i, " ".join(words[:i] + ["changed"] + words[i + 1 :])) for i in range(120)]
    rows += [(200 + i, f"another text number {i} with its own words {i * i}") for i in range(50)]
    check_near(table(rows), rows)


def test_one_of_each_keeps_the_smallest_id(clashing):
    kept = simhash.one_of_each(clashing)
    assert kept.schema.names == clashing.schema.names
    ids = {r.component_id for r in simhash.near_copies(clashing).collect()}
    assert {r.doc_id for r in kept.collect()} == ids


def test_one_of_each_with_repeated_and_null_ids(table):
    near = [f"w{i}" for i in range(400)]
    text, close = " ".join(near), " ".join(near[:200] + ["changed"] + near[201:])
    other, third = "quite another text of its own", "a third one without any id at all"
    rows = [
        (2, text), (2, close), (3, text), (3, other), (3, other), (2, third),
        (None, text), (None, "no id here, not even one"), (None, "no id here, not even one"),
    ]
    docs = table(rows)
    component = {r.doc_id: r.component_id for r in simhash.near_copies(docs.filter("doc_id = 2")).collect()}
    assert component == {2: 2}
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]
    want = simhash.fingerprint(text), simhash.fingerprint(close)
    assert bin((want[0] ^ want[1]) & simhash.WHOLE).count("1") <= simhash.RADIUS
    first = text if want[0] < want[1] else close
    if want[0] == want[1]:
        first = min((text, close), key=lambda t: hashlib.md5(t.encode()).digest())
    assert sorted(kept, key=repr) == sorted(
        [(2, first), (3, other), (2, third), (None, "no id here, not even one")], key=repr
    )


def linked(values, large):
    forest = simhash.Forest()
    array = np.sort(np.array(sorted(values), np.uint64))
    kept, flipped = (np.array(x, np.uint64) for x in zip(*simhash.flips()))
    keys = ((array[:, None] & kept) ^ flipped).ravel()
    members = np.repeat(array, len(kept))
    order = np.argsort(keys, kind="stable")
    keys, members = keys[order], members[order]
    if large:
        for key in np.unique(keys):
            simhash.link_large(key, members[keys == key], forest)
    else:
        for key in np.unique(keys):
            simhash.link_small(keys[keys == key], members[keys == key], forest)
    return {int(v): forest.root(int(v)) for v in array}


@pytest.mark.parametrize("large", [True, False])
def test_buckets_find_every_link(large):
    random.seed(8)
    values = set()
    for _ in range(6):
        centre = random.getrandbits(64)
        for _ in range(12):
            value = centre
            for _ in range(random.randrange(7)):
                value ^= 1 << random.randrange(64)
            values.add(value)
    want, got = brute_components(values), linked(values, large)
    pairs = lambda of: {frozenset(v for v in of if of[v] == of[u]) for u in of}
    assert pairs(got) == pairs(want)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(400)] + [(1000, 1001), (1001, 1000), (1002, 1002)]
    random.seed(2)
    random.shuffle(links)
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.least for r in found} == {**{i: 0 for i in range(401)}, 1000: 1000, 1001: 1000}
