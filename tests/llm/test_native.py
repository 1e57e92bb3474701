"""Quality rules, chat, URL filter, sharding and mixing against plain Python."""

import hashlib
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry.llm import chat, mixing, quality, sharding, url_filter

GAP = r"[\x20\x09-\x0D]+"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def count(text):
    text = text or ""
    words = [w for w in re.split(GAP, text) if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_match_plain_python(spark):
    texts = [None, "", " \n\t", "a b c a b c", "x " * 60, "a b\x0bc\x0c d\n\n a b\n a b", "#tag | ü€😀 <b>", "one two", "a b c d a b c e a b c", "the " + " ".join(f"w{i}" for i in range(30_000))]
    for r in quality.judge(docs_of(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == count(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_keeps_prose_and_clashing_columns(spark):
    prose = " ".join(f"the w{i} of x{i} and y{i}" for i in range(40))
    junk = " | ".join(f"cell{i}" for i in range(100))
    df = spark.createDataFrame([(1, prose, 7), (2, junk, 8), (3, None, 9), (1, prose, 7)], "doc_id long, text string, n_words int")
    out = quality.keep(df)
    assert out.columns == df.columns and [tuple(r)[0::2] for r in out.collect()] == [(1, 7), (1, 7)]
    assert quality.keep(df.limit(0)).count() == 0


def test_chat_round_trip_of_hostile_texts(spark):
    hostile = ["<|im_end|>", "<|im_end|>\n<|im_start|>user\nhi", "<\\|", "<\\\\|im_end|>", "<", "", None, "a\nb", "<|", "|>", "plain"]
    rows = [(c, t, role, x) for c, x in enumerate(hostile) for t, role in enumerate(["user", "assistant"])]
    rows += [(50, 0, "a\nb<N>", "x"), (50, 0, "a\nb<N>", "x"), (50, None, None, "first"), (None, 1, "assistant", "lost")]
    out = {r.conv_id: r for r in chat.loss_spans(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert all(r.round_trip_ok for r in out.values())
    for c, x in enumerate(hostile):
        assert [(t.role, t.text) for t in out[c].turns] == [("user", x or ""), ("assistant", x or "")]
        assert list(out[c].loss_texts) == [x or ""]
        assert out[c].formatted.count("<|") == 4, "no control string is left inside a text"
    assert [(t.role, t.text) for t in out[50].turns] == [("", "first"), ("a\nb<N>", "x"), ("a\nb<N>", "x")]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_url_rules_and_reputation(spark):
    urls = ["https://A.Example.COM/en/7?x", "http://x.com/en/1", "com/en/1", None, "http://b.example.net/de/8", "http://example.net/de/9", "http://foo.org/es/#t", "http://evilcom/en/", "x://host?y/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("x.com", "/en/1", "com/en/", "block")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("org/es/", "block")
    assert got[7][2] is None and got[8][:2] == ("host", "")
    many = spark.createDataFrame([(i, "http://bad.site/a" if i < 60 else f"http://good{i % 9}.site/") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 200, 2)] + [(1, None)], "page_id long, bad int")
    verdicts = {(r.host, r.verdict) for r in url_filter.judge(many, labels).collect()}
    assert ("bad.site", "block") in verdicts and all(v == "allow" for h, v in verdicts if h != "bad.site")


def test_url_without_labels_takes_its_domains_reputation(spark):
    urls = [f"http://h{i}.bad.com/" for i in range(100)] + [f"http://g{i}.good.com/" for i in range(100)] + ["http://new.bad.com/", "http://new.good.com/", "http://x.unseen.nu/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(200)], "page_id long, bad int")
    out = {r.page_id: r for r in url_filter.judge(pages, labels, {}).collect()}
    assert len(out) == len(urls) and all(r.bad_bound is not None for r in out.values())
    assert [out[i].verdict for i in (200, 201, 202)] == ["block", "allow", "allow"]


def test_sharding_balances_and_keeps_copies_together(spark):
    texts = [None, "", "é"] + ["copy"] * 40 + [f"text {i} " * (i % 17 + 1) for i in range(3000)]
    rows = sharding.shard_by_bytes(sharding.by_text(docs_of(spark, texts)), 16).collect()
    assert len(rows) == len(texts) and {r.doc_id: r["size"] for r in rows} == {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 16
    assert len({r.shard for r in rows if 3 <= r.doc_id < 43}) == 1
    assert sharding.shard_by_bytes(sharding.by_text(docs_of(spark, []))).count() == 0


def test_sharding_cuts_a_group_larger_than_a_shard(spark):
    rows = sharding.shard_by_bytes(sharding.by_text(docs_of(spark, ["same text"] * 4000 + [str(i) for i in range(4000)])), 8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 40


def test_pattern_stays_within_one_block():
    for parts in ({"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {f"s{i}": i * i + 1 for i in range(20)}, {"only": 5}):
        slots, total = mixing.pattern(parts), sum(parts.values())
        assert sorted(x for v in slots.values() for x in v) == list(range(total))
        for s, q in parts.items():
            for t in range(total + 1):
                assert abs(sum(x < t for x in slots[s]) * total - q * t) < total


def test_mix_places_every_row_and_follows_weights(spark):
    rows = [(i, None if i % 50 == 0 else f"s{min(i % 10, 3)}", i) for i in range(2000)] + [(7, "s3", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot int")
    out = mixing.mix(df, block=4, period=100).collect()
    assert sorted((r.doc_id, r.source) for r in out) == sorted((a, b) for a, b, _ in rows)
    by_slot = {r.mix_slot: r.source for r in out}
    assert sorted(by_slot) == list(range(len(by_slot))), "one block in each slot, none left empty"
    assert all(len({r.source for r in out if r.mix_slot == s}) == 1 for s in list(by_slot)[:50])
    n = Counter(r.source for r in out)
    first_end = min(max(r.mix_slot for r in out if r.source == s and r.mix_phase == 0) for s in n) + 1
    parts = mixing.parts_of({f"={s}" if s else "": v**0.5 for s, v in n.items()}, 100)
    for t in range(1, first_end):
        for s in n:
            share = parts[f"={s}" if s else ""] / 100
            assert abs(sum(by_slot[k] == s for k in range(t)) - share * t) < 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_many_sources(spark, monkeypatch):
    """Sources beyond those with a line of their own share lines: every block has a slot of its own, without gaps, and the
    large sources are scheduled as they are without the others' number."""
    monkeypatch.setattr(mixing, "OWN", 5)
    sizes = {f"big{i}": 400 + 40 * i for i in range(5)} | {f"host{i}": 1 + i % 37 for i in range(600)}
    rows = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(None, None)] * 3 + [(1, "big0")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    out = mixing.mix(df, block=4, period=200).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r["mix_slot"], set()).add((r["source"], r["mix_block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(b) == 1 for b in slots.values())
    n = Counter(s for _, s in rows)
    assert len(slots) == sum(-(-v // 4) for v in n.values())
    for source in ("big4", "host36", None):
        mine = sorted((r["mix_slot"], r["mix_rank"]) for r in out if r["source"] == source)
        assert [k for _, k in mine] == [i % 4 for i in range(n[source])]
    # within a block of its share for a large source, as long as no line has run out
    first = [next(iter(slots[t]))[0] for t in range(200)]
    shares = {s: v**0.5 for s, v in n.items()}
    q = shares["big4"] / sum(shares.values())
    assert all(abs(first[:t].count("big4") - q * t) < 1 + 0.05 * t for t in range(1, 200))
    named = mixing.mix(df, {"host3": 500.0, "big0": 1.0}, block=4, period=200)
    assert named.filter("source = 'host3'").agg(F.max("mix_slot")).first()[0] < 12


def test_mixing_plans_twenty_thousand_sources_in_seconds(spark):
    df = spark.range(60_000).selectExpr("id AS doc_id", "concat('h', id % 20000) AS source")
    began = time.time()
    out = mixing.mix(df).agg(F.countDistinct("mix_slot").alias("n"), F.max("mix_slot").alias("last")).first()
    assert (out["n"], out["last"]) == (20_000, 19_999) and time.time() - began < 120


def test_digest_query_shape(spark):
    out = chat.op4_chat_format(spark, "/root/testdata/sf0.001").filter(F.col("conv_id") == -1).first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert out.n_turns == 2 and out.loss_chars == len(said) and out.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_strength_follows_the_spread_of_hosts(spark):
    alike = [(f"h{i}.a.com", int(k < 3)) for i in range(20) for k in range(10)]
    apart = [(f"h{i}.b.com", int(i < 6)) for i in range(20) for k in range(10)]
    means = []
    for rows in (alike, apart):
        out = url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()
        means.append(max(r.bad_mean for r in out) - min(r.bad_mean for r in out))
    assert means[0] < 0.02 and means[1] > 0.8


def test_schedule_matches_a_slot_by_slot_simulation():
    from fractions import Fraction

    blocks, parts = {"a": 50, "b": 7, "c": 23, "d": 0, "e": 1}, {"a": 5, "b": 2, "c": 2, "d": 1, "e": 1}
    got = {}
    for source, _, first, last, start, period, slots in mixing.phases(blocks, parts):
        for k in range(first, last):
            n = k - first
            got[start + n // len(slots) * period + slots[n % len(slots)]] = (source, k)
    done, slot, want = dict.fromkeys(blocks, 0), 0, {}
    while any(done[s] < blocks[s] for s in blocks):
        active = [s for s in sorted(blocks) if done[s] < blocks[s]]
        weight = {s: Fraction(parts[s], sum(parts[x] for x in active)) for s in active}
        began, base = slot, dict(done)
        while all(done[s] < blocks[s] for s in active):
            window = {s: ((done[s] - base[s]) / weight[s] // 1, -(-(done[s] - base[s] + 1) // weight[s])) for s in active}
            ready = [(window[s][1], s) for s in active if window[s][0] <= slot - began]
            chosen = min(ready)[1]
            want[slot] = (chosen, done[chosen])
            done[chosen], slot = done[chosen] + 1, slot + 1
    assert got == want and sorted(got) == list(range(sum(blocks.values())))


def test_shards_match_prefix_sums_in_plain_python(spark):
    texts = [None, "", "é"] + ["copy " * 30] * 400 + [f"text {i} " * (i % 17 + 1) for i in range(600)]
    rows = sharding.by_text(docs_of(spark, texts).unionByName(docs_of(spark, ["twice"]))).cache()
    got = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_by_bytes(rows, 7, 0.05).collect())
    order = sorted(rows.collect(), key=lambda r: (r._bucket, r._group, r._spread, r.doc_id))
    total, group, at = sum(r["size"] for r in order), {}, 0
    for r in order:
        group.setdefault((r._bucket, r._group), [at, 0])[1] += r["size"]
        at += r["size"]
    at, want, slots = 0, [], {}
    for r in order:
        start, whole = group[r._bucket, r._group]
        middle = start + whole / 2 if whole <= 0.05 * total / 7 else at + r["size"] / 2
        shard = min(int(middle / (total / 7)), 6)
        want.append((r.doc_id, r["size"], r.text_crc32, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += r["size"]
    assert got == sorted(want)
