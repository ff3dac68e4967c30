import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeline.llm import common, fingerprint, media, mixing, packing, quality, sharding, warc

from .tables import documents, frame


@pytest.fixture(scope="module")
def rows():
    return documents()


def test_packing_ids_and_layout(spark, rows):
    from tokenizers import Tokenizer

    rows = [*rows, (None, "it's 12 DON'T <|endoftext|> ÉÉ...", None, None), (7, None, None, None)]
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[d, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack_documents(frame(spark, rows), 64).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 64) * 1.1 + 1


def test_plan_places_every_piece_once():
    r = np.random.default_rng(2)
    counts = {int(n): int(r.integers(1, 40)) for n in r.choice(np.arange(1, 101), 60, replace=False)}
    runs, bins = packing.plan(counts, 100)
    used = Counter()
    for n, c in counts.items():
        begin = [x[0] for x in runs[n]]
        for number in range(c):
            k = np.searchsorted(begin, number, "right") - 1
            first, sequence, each, offset = runs[n][k]
            q, m = divmod(number - first, each)
            key = (sequence + q, offset + m * n)
            for place in range(key[1], key[1] + n):
                used[key[0], place] += 1
    assert max(used.values()) == 1 and max(p for _, p in used) < 100
    assert {s for s, _ in used} == set(range(bins))
    for s in range(bins):
        filled = sorted(p for q, p in used if q == s)
        assert filled == list(range(len(filled)))


def test_fingerprints_follow_their_contract(spark, rows):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, rows).repartition(5)).collect()}
    ordered = sorted(rows, key=lambda x: x[0])
    for (d, text, *_), (_, following, *_) in zip(ordered, [*ordered[1:], ordered[0]]):
        text, following = text or "", following or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        assert got[d]["n_chars"] == len(text)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == text:
            assert got[d]["fingerprint"] == got[d]["edited_fingerprint"] and got[d]["near_edited"] == 1
        if len(text) > 400 and len(following) > 400 and text != following:
            assert got[d]["near_edited"] > got[d]["near_next"]


def test_prefix_hash_extension():
    a, b = fingerprint.code_points("xx" + "abcdé" * 300 + "q"), fingerprint.code_points("abcdé" * 300 + "r")
    x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    assert x.extension(2, y, 0) == 1500 and x.equal(2, y, 0, 1500) and not x.equal(2, y, 0, 1501)
    assert x.extension(1501, y, 1499) == 1


def test_fingerprints_of_one_null_and_no_rows(spark):
    one = fingerprint.fingerprints(frame(spark, [(None, None, None, None)])).collect()
    assert one[0]["n_chars"] == 0 and one[0]["near_next"] == 1
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 1500
    pages = [(1, "http://a", big), (2, "http://b", big), (2, "http://b", big), (3, None, "small"), (4, "http://c", "small"), (5, "http://d\n", None), (None, "http://e", big), (6, "http://f", "é" * 600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    manifest = warc.write_warc(df, path, roll=1)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages) and manifest.count() > 3
    got = sorted(warc.read_warc(spark, path).collect(), key=lambda r: (r["page_id"] or 0, r["record_type"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(None, "response", None), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)]
    assert all(r["payload_bytes"] == 1503 and r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() for r in got[:4])
    again = warc.write_warc(df.repartition(3), f"file://{tmp_path}/v", roll=1)
    assert sorted(manifest.select("file", "sha1").collect()) == sorted(again.select("file", "sha1").collect())
    assert warc.write_warc(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_broken_warc_is_noticed():
    raw = warc.record(1, "http://a", b"hello", hashlib.sha1(b"hello").hexdigest())
    assert len(list(warc.records_of(raw + raw))) == 2
    for bad in (raw[:-1], raw.replace(b"hello", b"hallo"), b"x" + raw):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_filters(channels):
    r = np.random.default_rng(channels)
    image = r.integers(0, 256, (7, 5 * channels)).astype(np.uint8)
    color = {v: k for k, v in media.CHANNELS.items()}[channels]
    raw = bytearray()
    for y in range(7):
        kind = y % 5
        up = image[y - 1].astype(int) if y else np.zeros(5 * channels, int)
        line = []
        for x in range(5 * channels):
            a = int(image[y, x - channels]) if x >= channels else 0
            b = int(up[x])
            c = int(up[x - channels]) if x >= channels else 0
            p = a + b - c
            paeth = min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2]
            line.append((int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        raw += bytes([kind, *line])
    import struct

    file = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, color, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(raw))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(file).reshape(7, -1) == image).all()
    broken = bytearray(file)
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


def test_media_columns_round_trip(spark, rows):
    files = media.encode_bytes(frame(spark, rows).select("doc_id", F.col("text").cast("binary").alias("b")), "b")
    got = media.decode_media(files, "png").select("doc_id", "media.samples", "media.error").collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        assert r["error"] is None and bytes(r["samples"]).rstrip(b"\0") == texts[r["doc_id"]].rstrip(b"\0")


def test_media_digests_match_brute_force(spark, rows):
    """What op6 tells, against the bytes themselves and a PNG read by its parts."""
    rows = [*rows, (None, None, None, None), (3, "x" * 64, None, None), (3, "x" * 64, None, None), (4, "é" * 40_000, None, None)]
    got = media.media_digests(media.stored_media(frame(spark, rows).withColumn("media", F.lit(1)))).collect()
    want = Counter()
    for d, text, *_ in rows:
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        file = media.encode_png(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        idat, at = b"", 8
        while at < len(file):
            size = int.from_bytes(file[at : at + 4], "big")
            idat += file[at + 8 : at + 8 + size] if file[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + size
        raw = zlib.decompress(idat)
        lines, before = [], bytes(64)
        for y in range(0, len(raw), 65):
            kind, line = raw[y], bytearray(raw[y + 1 : y + 65])
            for x in range(64):
                line[x] = (line[x] + (0, line[x - 1] if x else 0, before[x])[kind]) & 255
            before = bytes(line)
            lines.append(before)
        assert b"".join(lines) == payload
        want[d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest()] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    features = {r["payload_sha256"]: r["feature"] for r in got}
    assert all(features[r["payload_sha256"]] == r["feature"] and len(r["feature"]) == 16 for r in got)


def test_broken_media_say_why(spark):
    good = media.encode_png(media.bytes_as_samples(b"abc"))
    rows = spark.createDataFrame([(1, None), (2, b"x"), (3, good[:-3]), (4, good)], "k int, f binary")
    got = {r["k"]: r["media"] for r in media.decode_media(rows, "f").collect()}
    assert [got[k]["error"] is None for k in (1, 2, 3, 4)] == [False, False, False, True] and got[1]["samples"] is None
    assert got[4]["width"] == 64 and bytes(got[4]["samples"]) == b"abc".ljust(64, b"\0")


def test_packed_sequences_hold_the_ids(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    packed = packing.pack_documents(frame(spark, rows), 64, ids=True)
    got = packing.sequences(packed).collect()
    assert all(len(r["ids"]) <= 64 for r in got)
    parts = {(r["doc_id"], r["start"]): (r["sequence_id"], r["offset"], r["length"]) for r in packed.collect()}
    ids = {r["sequence_id"]: r["ids"] for r in got}
    for d, text, *_ in rows:
        whole = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        read, at = [], 0
        while (d, at) in parts:
            s, o, n = parts[d, at]
            read += ids[s][o : o + n]
            at += n
        assert read == whole


def test_groups_that_carry_ids_are_parted(spark, monkeypatch):
    rows = [(i, "word " * 20 + f"n{i}") for i in range(80)] + [(100, "more words " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = ["doc_id", "piece", "start", "length", "ids_crc32"]
    plain = packing.pack_documents(docs, 64).collect()
    monkeypatch.setattr(packing, "GROUP_IDS", 256)
    parted = packing.pack_documents(docs, 64, ids=True).collect()
    assert sorted(tuple(r[c] for c in told) for r in plain) == sorted(tuple(r[c] for c in told) for r in parted)
    assert len({r["sequence_id"] for r in plain}) == len({r["sequence_id"] for r in parted})
    ends = Counter()
    for r in sorted(parted, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]] and len(r["ids"]) == r["length"]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 64


def test_ranges_part_nulls_and_hot_keys(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i) for i in range(3000)] + [(-(1 << 63), 1), ((1 << 63) - 1, 2)]
    docs = spark.createDataFrame(rows, "k long, v long")
    ranges = common.Ranges(docs, "k", F.xxhash64("v"), 12, F.lit(1))
    dealt = docs.select("k", ranges.number().alias("part")).collect()
    sizes = Counter(r["part"] for r in dealt)
    assert set(sizes) <= set(range(ranges.count)) and max(sizes.values()) < 700 and len(sizes) >= 10
    order = sorted(dealt, key=lambda r: (r["k"] is not None, r["k"] or 0))
    spans = {}
    for r in order:
        spans.setdefault(r["part"], []).append((r["k"] is not None, r["k"] or 0))
    ends = [(min(x), max(x)) for _, x in sorted(spans.items())]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_many_ranges_take_few_jobs_and_a_small_plan(spark):
    """20,000 ranges, over even keys and over keys that crowd together: a job a round, no code that grows with them."""
    import time

    for key, rounds in (("id", 1), ("cast(pow(id, 3) as bigint) % 1000000007 * if(id % 2 = 0, 1, 9000000)", 4)):
        docs = spark.range(100_000).select(F.expr(key).alias("k"))
        spark.sparkContext.setJobGroup(f"ranges-{rounds}", "")
        ranges = common.Ranges(docs, "k", F.xxhash64("k"), 20_000, F.lit(1))
        began = time.time()
        part = docs.select("k", ranges.number().alias("part"))
        part._jdf.queryExecution().executedPlan()
        assert time.time() - began < 2
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ranges-{rounds}")) <= 2 * (1 + rounds)
        got = part.groupBy("part").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
        assert len(got) > 9000 and max(r["n"] for r in got) <= 20
        assert all(x["b"] < y["a"] for x, y in zip(got, got[1:]))
    spark.sparkContext.setJobGroup("", "")


def test_fingerprints_of_many_unnamed_and_repeated_ids(spark):
    """Every row has the one after it as next, whatever its range."""
    r = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, "".join(r.choice(list("abc"), 30)), None, None) for i in range(90)]
    got = fingerprint.fingerprints(frame(spark, rows).withColumn("part", F.lit("x"))).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(x[0] for x in rows)
    keyed = frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [x["text"] for x in sorted(keyed, key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["h"]))]
    want = Counter(hashlib.sha256((a[:23] + b[:7]).encode()).hexdigest() for a, b in zip(order, [*order[1:], order[0]]))
    assert Counter(x["edited_sha256"] for x in got) == want
    start = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert Counter(x["shared_next"] for x in got) == Counter(start(a, b) for a, b in zip(order, [*order[1:], order[0]]))
    assert Counter(x["shared_edited"] for x in got) == Counter(start(a, a[:23] + b[:7]) for a, b in zip(order, [*order[1:], order[0]]))


def test_fingerprint_slots_match_brute_force(spark):
    """Slots and likeness from span hashes by Python's own integers."""
    mask = (1 << 64) - 1

    def finish(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & mask
        return x ^ x >> 31

    def slots(text, span=12):
        codes = [ord(c) + 1 for c in text]
        n = min(span, len(codes))
        least = {}
        for i in range(len(codes) - n + 1) if codes else ():
            high, low = (sum(c * pow(base, j, prime) for j, c in enumerate(codes[i : i + n])) % prime for base, prime in zip(fingerprint.BASES, fingerprint.PRIMES))
            h = finish(high << 31 | low)
            least[h >> 57] = min(h, least.get(h >> 57, mask))
        return "".join(f"{finish(least[s]) & 255:02x}" if s in least else "--" for s in range(128))

    texts = [None, "", "a", "ab" * 40, "The quick brown fox jumps over the lazy dog, é𝄞!", "zz" + "ab" * 40]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t) // 4
        mine, other, after = (slots(x) for x in (t, t[: len(t) - n] + following[:n], following))
        share = lambda a, b: (lambda p: sum(x == y for x, y in p) / len(p) if p else 1.0)([(x, y) for x, y in zip(zip(a[::2], a[1::2]), zip(b[::2], b[1::2])) if {x, y} != {("-", "-")}])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (mine, other)
        assert (got[i]["near_edited"], got[i]["near_next"]) == (share(mine, other), share(mine, after))


def test_mixed_documents_with_clashing_names(spark, rows):
    docs = frame(spark, rows)
    for name in ("_n", "_row", "_taken", "key", "size", "copies", "_copy"):
        docs = docs.withColumn(name, F.lit("x"))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    counts = Counter(r["doc_id"] for r in out.collect())
    plain = Counter(r["doc_id"] for r in mixing.mix_documents(frame(spark, rows)).collect())
    assert max(counts.values()) <= 3 and abs(sum(counts.values()) - sum(plain.values())) <= len(rows)
    flags = spark.createDataFrame([(1, None, "a b", None), (1, "a b", None, None)], "doc_id long, lang string, text string, source string")
    assert {(r["lang"], r["text"]) for r in mixing.mix_documents(flags).collect()} >= {(None, "a b")}


def test_mixing_nears_its_targets(spark, rows):
    light = frame(spark, rows).select("doc_id", "source", mixing.word_count().alias("size"))
    out = mixing.mix(light, "doc_id").collect()
    taken = defaultdict(int)
    goal, own = {}, {}
    for r in out:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        goal[r["source"]], own[r["source"]] = r["target"], r["source_size"]
    assert abs(sum(goal.values()) - sum(own.values())) < 1e-6
    for s, t in goal.items():
        assert t <= 3 * own[s] + 1e-6
        below = [r["size"] for r in out if r["source"] == s and r["copies"] < 3 and r["size"]]
        assert taken[s] <= t or all(taken[s] - t <= t - taken[s] + n for n in below)  # over only by less than it was under
    again = mixing.mix(light.repartition(7), "doc_id").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def brute_chances(sizes, ratio):
    """Inclusion probabilities of a source's documents in what its whole copies leave."""
    chance, total = ratio - math.floor(ratio), sum(sizes)
    if not chance:
        return [None] * len(sizes)
    short = [1024 * total // (total + len(sizes) * n) for n in sizes]
    mean = sum(n * g for n, g in zip(sizes, short)) / total
    return [chance + chance * (1.0 - chance) * ((g - mean) / 1024.0) for g in short]


def brute_prefixes(rows, rounds=mixing.ROUNDS):
    """Copies of rows (key, source, size, copy, rank, whole, budget): each round's longest prefix is
    found by walking it, and a last copy goes to the row that brings the source nearest to its budget."""
    took = set()
    extra = []
    for source in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == source and r[4] is not None), key=lambda r: (r[4], r[0], r[3], r[2]))
        left = mine[0][6] if mine else 0
        for i in range(rounds):
            budget = left
            for r in [r for r in mine if r not in took and (not i or r[2] <= budget)]:
                if r[2] > left:
                    break
                left -= r[2]
                took.add(r)
        near = [(abs(r[2] - left), r in took, r[4], r[0], r[3], r[2], r) for r in mine if r[5] + (r in took) < mixing.MOST and abs(r[2] - left) < left]
        extra += [min(near)[-1]] if near else []
    return Counter({r[:4]: r[5] + (r in took) + (r in extra) for r in rows})


def test_mixing_equals_walked_prefixes(spark):
    sizes = [(i % 37, None if i % 5 == 0 else f"s{min(i % 7, 3)}", (i * 7919) % 400 if i % 11 else 0) for i in range(900)]
    light = spark.createDataFrame([*sizes, *sizes[:40], (None, None, 9), (None, "lone", 1000), (1, "two", 5000), (2, "two", 4000)], "doc_id long, source string, size long")
    seen = mixing.mix(light, "doc_id")
    got = Counter({(r["doc_id"], r["source"], r["size"], r["copy"]): r["copies"] for r in seen.collect()})
    rows = []
    by_source = defaultdict(list)
    for r in seen.withColumn("u", mixing.uniform("doc_id", "source", "copy", seed=42)).collect():
        by_source[r["source"]].append(r)
    for mine in by_source.values():
        ratio = mine[0]["target"] / mine[0]["source_size"] if mine[0]["source_size"] else 0.0
        for r, p in zip(mine, brute_chances([r["size"] for r in mine], ratio)):
            whole = math.floor(ratio)
            odds = (r["u"] / (1 - r["u"])) / (p / (1 - p)) if p else None
            rank = None if odds is None else odds / (1 + odds)
            rows.append((-1 if r["doc_id"] is None else r["doc_id"], r["source"], r["size"], r["copy"], rank, whole, math.floor(r["target"] - whole * r["source_size"])))
    want = Counter({(None if k == -1 else k, s, n, c): v for (k, s, n, c), v in brute_prefixes(rows).items()})
    assert got == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where sources are too many to broadcast
    try:
        again = Counter({(r["doc_id"], r["source"], r["size"], r["copy"]): r["copies"] for r in mixing.mix(light, "doc_id").collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert again == got


def test_targets_of_sources_alike(spark):
    """Sources of one size and weight get one target, and all targets add up to all words."""
    light = spark.createDataFrame([(s, f"s{s:02d}", 100) for s in range(9)] + [(9, "s09", 1)], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(light).collect()}
    assert abs(sum(got.values()) - 901) < 1e-9 and got["s09"] == min(3.0, got["s00"])
    assert all(abs(got[f"s{s:02d}"] - (s % 3 + 1) * 898 / 18) < 1e-9 for s in range(9))


def test_mixing_includes_by_odds(spark):
    """Over many sources of the same sizes, documents are taken as often as their inclusion probability says: short ones more."""
    sizes = [20 + 3 * (i % 10) + 400 * (i % 3 == 0) for i in range(600)]
    light = spark.createDataFrame([(600 * s + i, f"s{s:03d}", n) for s in range(40) for i, n in enumerate(sizes)], "doc_id long, source string, size long")
    seen = mixing.mix(light, "doc_id", weights=2).collect()
    for kind, ratio in ((0, 2 / 3), (1, 4 / 3)):
        chances = brute_chances(sizes, ratio)
        assert min(chances) > 0 and max(chances) < 1
        assert abs(sum(p * n for p, n in zip(chances, sizes)) / sum(sizes) - ratio % 1) < 1e-9
        drawn = {True: [0.0, 0.0, 0], False: [0.0, 0.0, 0]}
        for r in seen:
            if int(r["source"][1:]) % 2 == kind:
                cell = drawn[r["size"] < 100]
                cell[0] += r["copies"] - math.floor(ratio)
                cell[1] += chances[r["doc_id"] % 600]
                cell[2] += 1
        rates = {short: (took / n, p / n) for short, (took, p, n) in drawn.items()}
        assert all(abs(took - p) < 0.03 for took, p in rates.values()), rates
        assert rates[True][0] > rates[False][0] + 0.1


def brute_shuffle(rows, shards):
    """Where the law `rows` lets records be: every (shard, slot) once, shards in equal parts."""
    edges = [s * len(rows) // shards for s in range(shards + 1)]
    return sorted((s, i) for s in range(shards) for i in range(edges[s + 1] - edges[s]))


def test_shards_are_even_and_repeatable(spark, rows):
    rows = [*rows, *rows[:9], (None, None, None, None), *[rows[3]] * 40]
    docs = frame(spark, rows)
    place = lambda d: sharding.shuffled(d, 5, buckets=4, repeats=8).collect()
    got = place(docs)
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == brute_shuffle(rows, 5)
    assert len({r["shard"] for r in got if tuple(r)[:4] == rows[3]}) > 2  # a hot record spreads
    assert sorted(map(str, got)) == sorted(map(str, place(docs.repartition(7))))
    assert sorted(map(str, got)) != sorted(map(str, sharding.shuffled(docs, 5, seed=1, buckets=4, repeats=8).collect()))


def test_shards_mix_records(spark):
    """Of 2,000 records in order each shard gets about as many of any quarter."""
    got = sharding.shuffled(spark.range(2000), 4, buckets=8).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == brute_shuffle(range(2000), 4)
    per = Counter((r["shard"], r["id"] // 500) for r in got)
    assert len(per) == 16 and all(90 <= n <= 160 for n in per.values())
    runs = [r["id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(b == a + 1 for a, b in zip(runs, runs[1:])) < 20


def test_shards_with_clashing_names_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "x", None), (1, "x", None), (None, None, None)], "shard long, _bucket string, slot string")
    got = sharding.shuffled(docs, 3).collect()
    assert Counter(tuple(r)[:3] for r in got) == Counter([(1, None, "x"), (1, "x", None), (1, "x", None), (None, None, None)])
    assert sorted((r["_shard"], r["_slot"]) for r in got) == brute_shuffle(got, 3)


def test_written_shards_hold_whole_long_records(spark, tmp_path):
    rows = [(i, f"{i} " * (60_000 if i % 5 == 0 else 3), "en", None) for i in range(40)] + [(7, "7 7 7 ", "en", None), (None, None, None, "s1")]
    docs = frame(spark, rows)
    got = sharding.write_shards(docs, str(tmp_path / "out"), 4, bucket_bytes=200_000).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in got) == Counter(rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == brute_shuffle(rows, 4)
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={i}" for i in range(4)}
    assert sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 4).count() == 0


def test_op7_writes_the_shards_it_reports(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(sharding, "shared_dir", lambda _: str(tmp_path), raising=False)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in sharding.op7_sharding(spark, str(tmp_path)).collect()}
    (path,) = tmp_path.glob("shards-*")
    texts = {(r["doc_id"], (r["text"] or "").encode(), r["shard"]) for r in spark.read.parquet(str(path)).collect()}
    assert {(d, t) for d, t, _ in texts} == {(r[0], (r[1] or "").encode()) for r in rows}
    assert got == {(d, len(t) + 1, zlib.crc32(t), s) for d, t, s in texts}


def test_quality_learns_a_rule(spark):
    rows = [(i, "good words here. " * 20 if i % 2 else "!!! ### $$$ " * 20, None, None) for i in range(200)]
    rows += [(1000, None, None, None), (1001, "", None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(frame(spark, rows), labels).collect()}
    assert kept >= {i for i in range(200) if i % 2} and not kept & {i for i in range(200) if i % 2 == 0}


def test_rules_score_as_they_say(spark, rows):
    """The column expression against the rules applied in Python, and edge cases of labels."""
    import math

    docs = frame(spark, rows).withColumn("s_chars", F.lit("x"))
    labels = spark.createDataFrame([(r[0], int(len(r[1] or "") % 2)) for r in rows] + [(rows[0][0], 1), (None, 1), (10**9, 0)], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(docs, labels))
    assert model.weighted
    got = quality.scored(docs, model, "score").collect()
    stats = {tuple(r)[:2]: r for r in quality.statistics(frame(spark, rows)).collect()}
    for r in got:
        of = stats[r["doc_id"], r["text"]]
        total = model.intercept
        for rule, weight in model.weighted:
            if all((low is None or of[f"s_{n}"] > low) and (high is None or of[f"s_{n}"] <= high) for n, low, high in rule.bounds):
                total += weight
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12) and r["s_chars"] == "x"
    kept = quality.keep_good(docs.withColumn("_score", F.lit(2)), labels)
    assert kept.columns == [*docs.columns, "_score"] and kept.count() == sum(r["score"] >= 0.5 for r in got)
    one = quality.fit(quality.training_rows(docs, labels.where("quality = 1")))
    assert one.constant == 1.0 and quality.fit(quality.training_rows(docs, labels.limit(0))).constant == 0.5
    assert quality.scored(docs.limit(0), model, "score").count() == 0
    assert [r[0] for r in spark.createDataFrame([(None,), (1,)], "doc_id long").select(quality.held_out()).collect()] == [False, zlib.crc32(b"1") % 3 == 1]


def test_held_out_accuracy(spark):
    """Held-out documents of a real table: area under the curve, and bad documents caught."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.training_rows(docs, labels))
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = quality.scored(docs.select("doc_id", "text"), model, "score").where(quality.held_out()).join(known, "doc_id").where("y IS NOT NULL").collect()
    good, bad = ([r["score"] for r in rows if r["y"] == y] for y in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.98 and sum(b < 0.5 for b in bad) > 0.95 * len(bad) and sum(g >= 0.5 for g in good) > 0.95 * len(good)


def test_no_rows(spark):
    none = frame(spark, [])
    assert packing.pack_documents(none).count() == 0
    assert mixing.mix(none.select("doc_id", "source", mixing.word_count().alias("size")), "doc_id").count() == 0
    assert sharding.shuffled(none).count() == 0


def test_word_ids_of_plain_words_are_the_tokenizers():
    import random

    rnd = random.Random(5)
    signs = "aAzZéÉßÿÀ'’sStTrReEvmlLdD09-.,;<|>×÷ªº́İΣK\u0085\x1c\x01~"
    words = {w for _ in range(5000) for w in "".join(rnd.choices(signs, k=rnd.randint(1, 9))).encode().split()}
    words |= {b"<|endoftext|>", b"x<|startoftext|>y", b"<|ENDOFTEXT|>", "µ".encode(), b"It's", b"WE'LL!?"}
    fast, whole = (packing.WordIds(packing.tokenizer_path()) for _ in range(2))
    assert fast.plain
    whole.plain = False
    assert [w for w in words if fast[w] != whole[w]] == []


def test_a_labelled_document_trains_once(spark):
    a, b = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(a, "b c"), (a, "a long text"), (a, None), (a, "b c"), (b, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, quality int")
    seen = sorted(quality.training_rows(docs, labels).collect())
    assert sorted((r["doc_id"], r["label"]) for r in seen) == [(a, 1.0), (b, 0.0)]
    assert seen == sorted(quality.training_rows(docs.dropDuplicates().repartition(3), labels).collect())
