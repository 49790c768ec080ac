"""Operators against brute force, round trips and held-out labels, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import gzip
import hashlib
import io
import itertools
import json
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from ebbmark.llm import bpe, chat, exactdup, html_extract, media, mixing, neardup, tokenfiles, toxicity, warc
from ebbmark.llm.components import components
from ebbmark.llm.queries import RANKS, VOCABULARY

ODD = [
    (1, "a b c d e f g", "x"), (2, None, None), (3, "", "x"), (4, "a b c d e f g", "y"), (None, "a b c d e f g", "x"), (4, "a b c d e f g", "y"), (5, " \n\t ", "z"), (6, "word " * 30_000, "x"),
    (7, "日本語 テキスト 🎉", "y"), (8, "<|endoftext|> it's\r\n\r\n  two  spaces", "x"), (9, "short", None), (10, "SHORT", "x"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(seed=0, n=160):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([2, 4, 5, 30, 60, 120]))] for _ in range(25)]
    out = []
    for k in range(n):
        b = list(r.choice(base)) if r.random() < 0.8 else [r.choice(words) for _ in range(r.randint(1, 80))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            b[r.randrange(len(b))] = r.choice(words)
        out.append((k, r.choice([" ", "  ", "\n"]).join(b).capitalize(), f"s{k % 3}"))
    return out


# Encoding


def test_codec_is_tiktoken_and_tokenizers():
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("tokenizers")
    one = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    two = tokenizers.Tokenizer.from_file(VOCABULARY)
    a, b = bpe.Codec(RANKS, cached=5000), bpe.Codec(VOCABULARY)
    r = random.Random(3)
    texts = [t or "" for _, t, _ in ODD] + ["a <|endoftext|> b", "<|endoftext|>" * 2, " <|endoftext|>\n<|endoftext", "日<|endoftext|>1"] + ["".join(r.choice(" \n\tab'sé日🎉.!1½　\x1c\xa0") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        want = one.encode_ordinary(t)
        assert a.encode(t) == want
        assert b.encode(t) == two.encode(t, add_special_tokens=False).ids
        assert b.encode(t) == want or "<|endoftext|>" in t
        assert a.decode(want) == t
    ids = a.encode("日本語 a🎉")
    assert all("日本語 a🎉"[s:e] for s, e in a.offsets(ids)) and a.offsets(ids)[-1][1] == 6
    assert "�" in a.decode(ids[:1])


def test_encode_and_decode(odd, none):
    df = odd.withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, RANKS, offsets="spans"), RANKS)
    assert out.filter("decoded <> coalesce(text, '')").count() == 0 and out.count() == len(ODD)
    assert bpe.encode(none, RANKS).count() == bpe.round_trip(none, RANKS).count() == 0
    got = {r["doc_id"]: r for r in bpe.round_trip(odd, RANKS).collect()}
    assert got[2]["n_tokens"] == 0 and got[3]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[7]["decoded_sha256"] == hashlib.sha256(ODD[8][1].encode()).hexdigest()


def test_token_files(spark, odd, none, tmp_path):
    folder = f"file://{tmp_path}/t"
    m = tokenfiles.write_token_files(odd, folder, VOCABULARY, shards=3)
    c, start = bpe.Codec(VOCABULARY), 0
    got = sorted(tokenfiles.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert len(got) == len(ODD) and [r["doc_id"] for r in got] == sorted((d for d, _, _ in ODD), key=lambda d: (d is not None, d or 0))
    texts = {d: t or "" for d, t, _ in ODD}
    for r in got:
        ids = [*c.encode(texts[r["doc_id"]]), 0]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(data))
        start += len(ids)
    assert m["tokens"] == start
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    again = tokenfiles.write_token_files(odd, folder, VOCABULARY, shards=3)
    assert again == m
    tokenfiles.write_token_files(none, f"file://{tmp_path}/e", VOCABULARY)
    assert tokenfiles.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


# Duplicates


@pytest.mark.parametrize("first, wider", [(1, 2), (4, 3), (64, 16)])
def test_exact_groups(spark, first, wider):
    rows = [(k, t, s) for k, t, s in documents(1)] + [(1000 + k, "a" * k, "s") for k in range(12)] + [(2000 + k, "a" * k, "s") for k in range(0, 12, 2)]
    got = {r["doc_id"]: r for r in exactdup.exact_groups(spark.createDataFrame(rows, SCHEMA), first=first, wider=wider).collect()}
    groups = collections.defaultdict(list)
    for k, t, _ in rows:
        groups[t].append(k)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for k in ids:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) == (max(ids), len(ids), k == max(ids))
            assert got[k]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_groups_odd(odd, none):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdup.exact_groups(odd).collect()), key=str)
    assert (4, 4, 4, True) in got and (1, 4, 4, False) in got and (None, 4, 4, False) in got and (2, 3, 2, False) in got and len(got) == len(ODD)
    assert exactdup.exact_groups(none).count() == exactdup.drop_copies(none).count() == 0
    kept = exactdup.drop_copies(odd.withColumn("kept", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9, 10] and kept.columns == [*odd.columns, "kept"]


def test_hot_groups_are_spread(spark):
    copies, other = 400, 100
    rows = [(7 if k % 2 else k, "hot " * 40, "s") for k in range(copies)] + [(1000 + k, f"{k}", "s") for k in range(other)] + [(2000 + k, "b" * 64 + "c" * (k % 2), "s") for k in range(other)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exactdup.exact_groups(docs).collect()}
    assert got == {(k, max(k for k, u, _ in rows if u == t), sum(u == t for _, u, _ in rows)) for k, t, _ in rows}
    head = spark.createDataFrame([(k, "a" if k else "b") for k in [1] * 300 + [0]], "k long, chunk string")
    groups = head.groupBy("chunk").agg(F.count("*").alias("n"))
    left, right = exactdup.spread(head, groups, ["chunk"], 4)
    assert left.groupBy("chunk", "part").count().agg(F.max("count")).head()[0] <= 76 and right.filter("chunk = 'a'").count() == 4
    assert left.join(right, ["chunk", "part"]).count() == 301


def test_copies_under_a_key_of_several_texts(spark):
    rows = [(1, "a", "x"), (1, "own", "x"), (2, "a", "x"), (1, None, "x"), (1, "", "x"), (2, "b", "x"), (3, "b", "x"), (4, "c", "x"), (4, "c", "x")]
    kept = exactdup.drop_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, ""), (1, "own"), (2, "a"), (3, "b"), (4, "c")]


@pytest.mark.parametrize("seed", range(3))
def test_drop_copies_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, 5, 9, *range(20, 30)]), r.choice([None, "", "a", "b", "a" * 3000, "a" * 3000 + "b"]), r.choice("xyz")) for _ in range(80)] + [(5, "a", "x"), (9, "a", "x"), (5, "b", "x")]
    kept = exactdup.drop_copies(spark.createDataFrame(rows, SCHEMA).withColumns({"kept": F.lit(1), "group": F.lit(2), "key": F.lit(3), "rest": F.lit(4)}))
    assert kept.columns == ["doc_id", "text", "source", "kept", "group", "key", "rest"]
    got = collections.Counter((x["text"] or "", x["doc_id"]) for x in kept.collect())
    best = {t: max((d for d, u, _ in rows if (u or "") == t and d is not None), default=None) for t in {u or "" for _, u, _ in rows}}
    assert got == collections.Counter(best.items())


def brute(rows):
    sets, parent = {}, {}
    for k, t, _ in rows:
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        parent[k] = k

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(k)
    return {k: min(g) for g in groups.values() for k in g}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("seed, block", [(0, 512), (1, 7)])
def test_near_duplicates(spark, seed, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 1 << 12 if block < 512 else neardup.BLOCK_BYTES)
    rows = documents(seed)
    component, size = brute(rows)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert {k: (r["component_id"], r["n_shingles"], r["kept"]) for k, r in got.items()} == {k: (component[k], size[k], component[k] == k) for k in got}


def test_groups_of_many_blocks(spark, monkeypatch):
    """Blocks of a few documents each, so that every large group has many."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 1 << 11)
    rows = documents(2, 110)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)[0]


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd.withColumn("kept", F.lit(0))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) and by[4]["component_id"] == 1 and by[1]["kept"] and not by[4]["kept"]
    assert by[10]["component_id"] == 9 and [by[k]["n_shingles"] for k in (2, 3, 5)] == [0, 0, 0] and all(by[k]["kept"] for k in (2, 3, 5, 6, 7, 8, 9))
    assert by[None]["component_id"] is None and by[6]["n_shingles"] == 1
    assert neardup.near_duplicates(none).count() == neardup.keep_first(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in neardup.keep_first(odd).collect()) == sorted(["1", "2", "3", "5", "6", "7", "8", "9", "None"])


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 99), (5, 5)], "a long, b long")
    assert {r["id"]: r["component"] for r in components(links).collect()} == {k: 1 for k in range(1, 41)} | {99: 99, 100: 99}


# Mixing


def test_high_rates_are_sums_of_draws(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.lit("a").alias("source"))
    n = mixing.mix(rows, {"a": 1.0}, total=40 * 10 * 1800.0).count()
    assert abs(n - 40 * 1800) < 6 * (40 * 1800) ** 0.5


def test_bounds_depend_on_keys_alone(spark):
    keys = spark.range(30_000).select((F.col("id") * 7 - 1000).alias("k")).union(spark.createDataFrame([(-(2**63),), (2**63 - 1,), (2**62,), (None,)], "k long"))
    found = {tuple(tokenfiles.shard_bounds(keys.repartition(n), "k", 9)) for n in (1, 3, 16)}
    assert len(found) == 1
    bounds = [-(2**63), *found.pop(), 2**63]
    sizes = [sum(a <= k < b for k in range(-1000, 209_000, 7)) for a, b in itertools.pairwise(bounds)]
    assert len(bounds) == 10 and max(sizes) < 1.2 * 30_000 / 9
    assert tokenfiles.shard_bounds(keys.limit(0), "k", 5) == [] and tokenfiles.shard_bounds(spark.range(5).select(F.lit(3).alias("k")), "k", 5) == []


def test_mix_is_poisson_with_target_rates(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") < 24_000, "big").when(F.col("id") < 29_000, "mid").otherwise("small").alias("source"))
    out = mixing.mix(rows, {"big": 0.5, "mid": 0.25, "small": 0.25}).persist()
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for source, want in (("big", 15_000), ("mid", 7_500), ("small", 7_500)):
        assert abs(n[source] - want) < 5 * want**0.5
    seen = collections.Counter(r["copies"] for r in out.filter("source = 'mid' AND copy = 0").collect())
    assert abs(seen[1] - 5000 * 1.5 * 2.718281828**-1.5) < 200 and abs(seen[2] - 5000 * 1.125 * 2.718281828**-1.5) < 200
    assert sorted(out.collect()) == sorted(mixing.mix(rows.repartition(7), {"big": 0.5, "mid": 0.25, "small": 0.25}).collect())
    first = [r["source"] for r in out.limit(300).collect()]
    assert len(set(first)) == 3


def test_mix_odd(odd, none):
    out = mixing.mix(odd.withColumn("copy", F.lit("clash")))
    counts = collections.Counter(d for d, _, _ in ODD)
    by = collections.defaultdict(list)
    for r in out.collect():
        by[r["doc_id"]].append(r)
    assert by and all(len(rows) == counts[d] * rows[0]["copies"] for d, rows in by.items())
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd, {}).count() == 0
    assert mixing.mix(odd, {"x": 1.0}).filter("source <> 'x' OR source IS NULL").count() == 0


# Toxicity


def test_folding():
    assert toxicity.fold("ІD1ОТ, f​o0­l").split() == ["idiot", "fool"]


def test_matching_exceptions_and_length():
    lex = toxicity.Lexicon({" trash": 5.0, " scum ": 6.0}, ("trash can", "pond scum"))
    a = lex.automaton()
    assert toxicity.signals("what tr4sh!", a)[0] == 5.0 and toxicity.signals("scum.", a)[0] == 6.0
    assert toxicity.signals("scummy retrash", a) == (0.0, 0.0) and toxicity.signals("a trash can", a) == (0.0, 0.0)
    assert toxicity.signals("trash " + "x " * 2000, a)[1] < toxicity.signals("trash", a)[1]


def test_learning_held_out(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = []
    for k in range(1500):
        w = [r.choice(words) for _ in range(r.randint(10, 60))]
        bad = k % 8 == 0
        if bad:
            w[r.randrange(len(w))] = "zork" + r.choice(words)
        rows.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = toxicity.learn(df.select("doc_id", "text"), df.filter("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = toxicity.score(df.filter("doc_id % 5 = 0"), lex).collect()
    assert sum((x["toxicity"] >= 0.5) == bool(x["toxic"]) for x in got) >= 0.98 * len(got)
    assert any(t.startswith(" zork") for t in lex.terms)


def test_learning_past_many_common_terms(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abcdefghijklmnopqrstuvwxy") for _ in range(9)) for _ in range(14_000)})
    rows = [(k, " ".join([*r.sample(words, len(words)), *["zorkmid"] * (k % 2 and k % 8 > 1)]), k % 2) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(set().union(*(toxicity._terms(x) for _, x, _ in rows))) > 70_000
    assert any(t.startswith(" zork") for t in toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic")).terms)


def test_sample_is_of_different_rows(spark):
    docs = spark.createDataFrame([(k, f"{t} {k} one two three four", "") for k, t, _ in documents(4, 60)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60) for _ in range(25)], "doc_id long, toxic int").persist()
    assert toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 20).count() >= 15
    many = docs.unionByName(spark.createDataFrame([(k, f"{k} {n} other text of this key", "") for k in range(60) for n in range(30)], SCHEMA))
    assert 0 < toxicity.training_rows(many, labels, "doc_id", "text", "toxic", 20).count() <= 20


def test_floor_of_terms():
    held = {1: 90_000, 2: 9_000, 3: 900, 5: 10}
    assert toxicity._floor(held, 20, 0.1) == (4, pytest.approx(4.302585))
    assert toxicity._floor(held, 2, 0.5)[0] == 3 and toxicity._floor({}, 5, 0.01)[0] == 1


def naive_signals(text, lexicon):
    """Without automaton: every term at every place."""
    folded, at = toxicity.fold(text), {}
    for term, weight in lexicon.terms.items():
        for k in range(len(folded)):
            if folded.startswith(term, k) and weight > at.get(k, 0.0):
                at[k] = weight
    spans = [(k, k + len(f) - 1) for e in lexicon.exceptions for f in [toxicity.fold(e)] for k in range(len(folded)) if folded.startswith(f, k)]
    at = {k: w for k, w in at.items() if not any(a <= k < b for a, b in spans)}
    return (max(at.values()), sum(at.values()) / (1 + len(text) / 100) ** 0.5) if at else (0.0, 0.0)


def test_signals_against_brute_force():
    r = random.Random(2)
    lexicon = toxicity.Lexicon({" ab": 1.0, " abc": 2.0, " b ": 0.5, " ca": 1.5}, ("abc b", "b ca", "ab ab"))
    automaton = lexicon.automaton()
    for _ in range(600):
        text = "".join(r.choice("abc  ,.") for _ in range(r.randint(0, 40)))
        assert toxicity.signals(text, automaton) == pytest.approx(naive_signals(text, lexicon))
    start = time.perf_counter()
    toxicity.signals("abc b " * 40_000, automaton)
    assert time.perf_counter() - start < 5


def test_folding():
    assert toxicity.fold("\u00efd\u00ed\u00f3t \U0001d4ea\U0001d4eb\U0001d4ec", plain=True) == " idiot abc "
    assert toxicity.fold("R\u00c9 i\u0336d") == " r\u00e9 id "
    assert toxicity.fold("1d10t i-d-i-o-t f o o l, a b") == " idiot idiot fool a b "
    assert toxicity.fold("") == "  " or toxicity.fold("").strip() == ""


def test_exceptions_are_learned(spark):
    """Trash is toxic, but not beside can."""
    r, rows = random.Random(6), []
    words = ["".join(r.choice("bdfglmnprstv") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    for k in range(1500):
        text = [r.choice(words) for _ in range(12)]
        if k % 5 == 0:
            text[3:4] = [r.choice(["trashy", "morons"])]
        elif k % 20 == 1:
            text[3:4] = ["trashy", "bins"]
        rows.append((k, " ".join(text), int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df, df)
    assert " trashy bins " in lexicon.exceptions
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark.createDataFrame([(1, "x trashy bins y"), (2, "you trashy thing"), (3, "m\u00f6r0ns all")], "doc_id long, text string"), lexicon).collect()}
    assert got[1] < 0.5 < got[2] and got[3] > 0.5


def test_toxicity_odd(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    lex = toxicity.learn(odd, empty)
    assert not lex.terms and toxicity.score(odd.withColumn("toxicity", F.lit("x")), lex).filter("toxicity BETWEEN 0 AND 1").count() == len(ODD)
    assert toxicity.score(none, lex).count() == 0
    assert toxicity.learn(odd, spark.createDataFrame([(1, None), (4, 1), (None, 1), (9, 0)], "doc_id long, toxic int")).terms == {}


# HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>";</script></head><body class=x><nav><ul><li><a href="/a">Menu</a></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy</div><div id="cookie-notice">We use</div><form><p>Search</p></form><article class="post-12"><h1>Title &amp; more</h1><p><b>First&nbsp;  one.<br><p>Second
line <i>in</i>line &lt;x&gt; a < b<div class="comments"><p>Nice!</p></div><aside>side</aside><table><tr><td>c1<td>c2</table></article><section class="sidebar"><p>""" + "long sidebar text. " * 80 + "</p></section><footer>&copy; me</footer></body></html>"


def test_main_text():
    want = "Title & more\nFirst one.\nSecond line inline <x> a < b\nc1\nc2"
    assert html_extract.main_text(PAGE, []) == want == html_extract.main_text(PAGE, ["nope", "html>body.x>article.post-"][:1])
    assert html_extract.best_path(html_extract.blocks(PAGE))[0].endswith("article.post-")
    for bad in ("", "<", "<p", "<!--", "<script>", "text only", "<div " + "a='" * 5000, "</p></p>", "&#0;&bogus;", "<p>" * 3000 + "x"):
        html_extract.main_text(bad, [])
    assert html_extract.main_text("text only", []) == "text only"


def test_hosts_agree(spark):
    lone = "<body><div class='teaser'><p>" + "short news, " * 40 + "</p></div><div class='story'><p>" + "tale " * 30 + "</p></div></body>"
    usual = "<body><div class='teaser'><p>x</p></div><div class='story'><p>" + "tale of things, " * 40 + "</p></div></body>"
    pages = spark.createDataFrame([(k, f"http://H.com/{k}", usual) for k in range(9)] + [(9, "http://h.com:80/9", lone), (10, "http://other.org", lone), (11, None, None), (12, "nonsense", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(pages.withColumn("main_text", F.lit(1))).collect()}
    assert got[9] == ("tale " * 30).strip() and got[10].startswith("short news") and got[11] == got[12] == "" and len(got) == 13
    assert html_extract.extract(pages.limit(0)).count() == 0


P = "<p>" + "words of the text, " * 12 + "</p>"
LINKS = "<div class='more'>" + "<p><a href='/x'>Another story to read</a></p>" * 30 + "</div>"


@pytest.mark.parametrize("page, parts", [
    (f"<body><div class='post'><div class='lead'>{P * 4}</div><div class='body'>{P * 6}</div></div>{LINKS}</body>", 10),
    (f"<body><div class='lead'>{P * 4}</div><div class='body'>{P * 6}</div>{LINKS}</body>", 10),
    (f"<div class='lead'>{P * 4}</div><div class='body'>{P * 6}</div>{LINKS}", 10),
    (f"<body><div class='content'>{P * 5}<table><tr><td>{P * 6}</table></div>{LINKS}</body>", 11),
    (f"<body><div class='content'>{P * 5}<ul><li>{P * 6}</ul></div>{LINKS}</body>", 11),
    (f"<body>{P * 5}<div class='rest'><div>{P * 2}</div><div class='end'>{P * 6}</div></div></body>", 13),
])
def test_split_pages_stay_whole(spark, page, parts):
    want = html_extract.main_text(page, [])
    assert want.count("words of the text, " * 11) == parts
    assert "Another story" not in want or page.startswith(("<body><div class='lead'", "<div class='lead'"))
    pages = spark.createDataFrame([(k, "http://split.org/a", page) for k in range(3)], "page_id long, url string, html string")
    assert {r["main_text"] for r in html_extract.extract(pages).collect()} == {want}


WRAPPERS = ("content-sidebar-wrap", "main has-sidebar", "post no-comments", "entry share-enabled", "site-content with-header", "news-alert-story", "restaurant-menu")


@pytest.mark.parametrize("name", WRAPPERS)
def test_wrappers_that_themes_name_after_what_is_beside(name):
    page = f"<body><nav><a href='/'>Home</a></nav><div class='{name}'><div class='x'>{P * 4}</div><div class='sidebar'><p>Side text of some length.</p></div></div><div class='comments'><p>I disagree!</p></div></body>"
    assert html_extract.main_text(page, []) == "\n".join(["words of the text, " * 11 + "words of the text,"] * 4)


def test_deep_pages_take_linear_time():
    start = time.perf_counter()
    for page in ("<div>" * 100_000 + "x", "<div>x" * 20_000, "<div class='a b'><span>" * 20_000 + "x", "<div>" * 300 + P + "</div>" * 300 + "<p>behind</p>"):
        assert html_extract.main_text(page, [])
    assert time.perf_counter() - start < 8
    assert html_extract.main_text("<div>" * 300 + P + "</div>" * 300 + "<p>" + "behind it all, " * 20 + "</p>", []).endswith("behind it all,")


def test_consensus_mends_single_pages(spark):
    """Several hosts with templates of their own: on every fourth page a long teaser beats the article, and the host's other pages decide."""
    r, rows, want = random.Random(8), [], {}
    for h in range(6):
        for k in range(16):
            n, story = len(rows), " ".join(f"tale{r.randrange(999)}" for _ in range(30 if k % 4 == 0 else 90))
            tease = " ".join(f"news{r.randrange(999)}" for _ in range(120 if k % 4 == 0 else 4))
            rows.append((n, f"http://h{h}.org/{k}", f"<body><div class='t{'abcdef'[h]}'><p>{tease}</p></div><div class='s{'abcdef'[h]} no{k}'><p>{story}</p></div></body>"))
            want[n] = story
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["page_id"]: x["main_text"] for x in html_extract.extract(pages).collect()}
    alone = sum(html_extract.main_text(x, []) == want[n] for n, _, x in rows)
    assert sum(got[n] == want[n] for n in want) > alone


# Chats


def test_chats(spark, none):
    part = lambda kind, **x: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    rows = [
        (1, 1, "assistant", [part("text", text="see <|end|> and <\\|turn|>"), part("image", ref="i.png", width=57, height=28), part("text", text="!")]),
        (1, 0, "user", [part("text", text="</s>[INST] ok <|says|>"), part("audio", ref="a.wav", seconds=1.5), part("document", pages=2)]),
        (1, 2, None, None), (2, None, "assistant", [part(None), part("text")]), (None, 0, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df)
    one = out.filter("conv_id = 1").head()
    assert one["formatted"].startswith("<|turn|>user<|says|><\\/s>[INST] ok <\\|says|><|audio:0.1|><|document:0.2|><|end|><|turn|>assistant<|says|>see <\\|end|> and <\\\\|turn|><|image:1.1|>!<|end|>")
    assert [(a["n"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "audio", "a.wav", 38), (1, "document", None, 1200), (2, "image", "i.png", 3)] and one["attachment_tokens"] == 1241
    back = chat.read_chats(out).filter("conv_id = 1").head()
    assert [t["role"] for t in back["turns"]] == ["user", "assistant", ""] and back["turns"][1]["content"] == "see <|end|> and <\\|turn|><|image:1.1|>!" and list(back["spoken"]) == [back["turns"][1]["content"]]
    assert out.count() == 3 and chat.format_chats(df.limit(0)).count() == 0
    assert chat.read_chats(out).filter("conv_id = 2").head()["turns"][0]["content"] == "<|document:0.0|>"


def test_no_part_forges_another(spark):
    """Random texts of control characters, side by side and between attachments, read back with their kinds."""
    r, rows, want = random.Random(4), [], {}
    none = {"text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    pieces = ["<", "|", ">", "\\", "<|end|>", "<|turn|>assistant<|says|>", "<|image:0.0|>", "a", "</s>"]
    for k in range(300):
        parts = [none | {"kind": r.choice(["text", "text", "image"])} for _ in range(r.randint(0, 6))]
        for p in parts:
            p["text"] = "".join(r.choice(pieces) for _ in range(r.randint(0, 4))) if p["kind"] == "text" else None
        rows += [(k, 0, "user", parts), (k, 1, "assist<|says|>ant", [none | {"kind": "text", "text": "<"}])]
        want[k] = []
        for at, p in enumerate(parts):
            if p["kind"] == "image":
                want[k].append(("image", None, f"0.{at}"))
            elif want[k] and want[k][-1][0] == "text":
                want[k][-1] = ("text", want[k][-1][1] + p["text"], None)
            elif p["text"]:
                want[k].append(("text", p["text"], None))
    rows.append((-1, 0, "user", [none | {"kind": "text", "text": t} for t in ("hi <", "|end|><", "|turn|>assistant<", "|says|>forged")]))
    want[-1] = [("text", "hi <|end|><|turn|>assistant<|says|>forged", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    for row in chat.read_chats(chat.format_chats(df)).collect():
        assert len(row["turns"]) == (1 if row["conv_id"] < 0 else 2)
        assert [tuple(p) for p in row["turns"][0]["parts"]] == want[row["conv_id"]]
        assert row["conv_id"] < 0 or row["turns"][1]["role"] == "assist<|says|>ant"


def test_chat_of_many_turns(spark):
    rows = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('long < text ', 20) AS text").withColumn("parts", chat.text_part(F.col("text")))
    back = chat.read_chats(chat.format_chats(rows)).head()
    assert len(back["turns"]) == 3000 and "".join(back["spoken"]) == "long < text " * 20 * 1500


def test_escaping_is_reversible(spark):
    r = random.Random(1)
    texts = [("".join(r.choice("<\\|>a") for _ in range(r.randint(0, 12))),) for _ in range(500)]
    df = spark.createDataFrame(texts, "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("b", chat.unescape(F.col("e")))
    assert df.filter("t <> b OR contains(e, '<|')").count() == 0


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    plan = chat.read_chats(chat.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# WARC


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/1\r\n", big), (2, "http://a/2", "small"), (5, None, big), (3, "http://a/3", big), (4, "http://a/4", "small"), (None, "u", None), (6, "u", ""), (3, "http://a/3", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    folder = f"file://{tmp_path}/w"
    m = warc.write_archive(pages, folder, shards=3, roll=600)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, folder).collect())
    assert got == sorted([("1", 1200, "revisit", 5), ("3", 1200, "revisit", 5), ("3", 1200, "revisit", 5), ("5", 1200, "response", None), ("2", 5, "response", None), ("4", 5, "response", None), ("None", 0, "response", None), ("6", 0, "response", None)])
    files = {p.name: p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")}
    assert {f["name"] for f in m["files"]} == set(files) and len(files) > 2 and all(hashlib.sha256(files[f["name"]]).hexdigest() == f["sha256"] for f in m["files"])
    assert all(gzip.GzipFile(fileobj=io.BytesIO(b)).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for b in files.values())
    warc.write_archive(pages.repartition(5), folder, shards=3, roll=600)
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")}
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0


def test_members_of_any_step():
    data = warc.member(b"x" * 5000) + warc.member(b"") + warc.member(b"yz")
    assert [list(warc.members(data, step)) for step in (1, 7, 1 << 16)] == [[b"x" * 5000, b"", b"yz"]] * 3
    with pytest.raises(ValueError):
        list(warc.members(data[:-3]))


# Media


def png(width=2):
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", width.to_bytes(4, "big") * 2 + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0" + b"\0" * width)) + chunk(b"IEND", b"")


def samples():
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0" + bytes(6) + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0\x12\xff\0\x34\xff\xd9"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\x01\0\x18\0" + bytes(24) + b"abc\0"
    return {
        "image/png": png(), "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "audio/wav": media.wav(b"ab" * 9), "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"hi" * 99),
        "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF", "video/mp4": b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x0cmoov" + bytes(4),
        "audio/ogg": b"OggS\0\x02" + bytes(20) + b"\x01\x03abc" + b"OggS\0\x04" + bytes(20) + b"\x01\x02de", "image/webp": b"RIFF\x0e\0\0\0WEBPVP8 \x02\0\0\0ab",
    }


@pytest.mark.parametrize("kind", samples())
def test_sniffing(kind):
    data = samples()[kind]
    assert media.finds(data) == [media.Find(kind, 0, len(data))]
    if kind != "application/pdf":
        assert media.finds(b"noise BM" + data + b"tail")[-1] == media.Find(kind, 8, len(data))
    assert all(f.start for f in media.finds(data[:-4])) or kind in ("application/pdf", "audio/ogg", "video/mp4")
    assert media.finds(b"") == media.finds(b"BM PK\x03\x04 GIF89a RIFF OggS text") == []


def more_samples():
    mpeg = lambda n: (b"\xff\xfb\x90\x00" + bytes(413)) * n
    entry = lambda tag, kind, count, value: tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + count.to_bytes(4, "little") + value.to_bytes(4, "little")
    tiff = b"II*\0" + (8).to_bytes(4, "little") + b"\x04\0" + entry(256, 3, 1, 1) + entry(257, 3, 1, 1) + entry(273, 4, 1, 62) + entry(279, 4, 1, 3) + bytes(4) + b"abc"
    box = lambda kind, data: (8 + len(data)).to_bytes(4, "big") + kind + data
    avi = b"AVI LIST" + (4).to_bytes(4, "little") + b"hdrl"
    ebml = b"\x1a\x45\xdf\xa3\x87\x42\x82\x84webm" + b"\x18\x53\x80\x67\x83abc"
    return {
        "audio/mpeg": mpeg(4), "image/tiff": tiff, "image/heic": box(b"ftyp", b"heic" + bytes(4)) + box(b"meta", bytes(9)), "audio/mp4": box(b"ftyp", b"M4A " + bytes(4)) + box(b"moov", bytes(5)) + box(b"mdat", b"xyz"),
        "video/quicktime": box(b"ftyp", b"qt  " + bytes(4)) + box(b"moov", b""), "image/avif": box(b"ftyp", b"avif" + bytes(4)) + box(b"meta", b""), "video/x-msvideo": b"RIFF" + len(avi).to_bytes(4, "little") + avi,
        "video/webm": ebml, "audio/flac": flac(3),
    }


def flac(frames):
    def crc(data, width, polynomial):
        r = 0
        for x in data:
            r ^= x << (width - 8)
            for _ in range(8):
                r = (r << 1 ^ polynomial if r >> (width - 1) else r << 1) & ((1 << width) - 1)
        return r.to_bytes(width // 8, "big")

    out = b"fLaC\x80\0\0\x22" + (16).to_bytes(2, "big") * 2 + bytes(6) + bytes(24)
    for k in range(frames):
        frame = b"\xff\xf8\xc9\x08" + bytes([k])
        frame += crc(frame, 8, 0x07) + b"\x00" + bytes([k, 7, k ^ 90])
        out += frame + crc(frame, 16, 0x8005)
    return out


@pytest.mark.parametrize("kind", more_samples())
def test_more_formats(kind):
    data = more_samples()[kind]
    assert media.finds(data) == [media.Find(kind, 0, len(data))]
    assert media.finds(b"noise " + data + b"tail")[-1] == media.Find(kind, 6, len(data))


def test_media_behind_one_another():
    """Every order of two formats and a third behind them: each is found with its own length."""
    all_ = samples() | more_samples()
    all_["application/pdf"] += b"\n"
    for a in all_:
        for b in all_:
            if a == b == "audio/mpeg":
                continue  # frames behind frames are one stream
            data, want, at = all_[a] + all_[b] + all_["image/png"], [], 0
            for kind in (a, b, "image/png"):
                want.append(media.Find(kind, at, len(all_[kind])))
                at += len(all_[kind])
            assert media.finds(data) == want, (a, b)
    pdf = all_["application/pdf"]
    assert [f.kind for f in media.finds(pdf + png() + pdf)] == ["application/pdf", "image/png", "application/pdf"]


def test_many_magic_bytes_take_linear_time():
    start = time.perf_counter()
    assert media.finds(b"PK\x03\x04" * 100_000) == media.finds(b"%PDF-1" * 50_000) == media.finds(b"II*\0" * 50_000) == []
    assert time.perf_counter() - start < 6


def test_media_column(spark):
    wav = media.wav(png() + b"!" * (len(png()) % 2))
    df = spark.createDataFrame([(1, png() + b"zz" + samples()["image/gif"], "image/jpeg"), (2, None, "a/b"), (3, bytearray(b"text"), None), (4, wav, "audio/wav")], "k long, media binary, type string").withColumn("carved", F.lit(1))
    got = {r["k"]: r for r in media.sniff(df).collect()}
    assert got[1]["found_type"] == "image/png" and got[1]["corrected"] and [(c["type"], c["start"]) for c in got[1]["carved"]] == [("image/gif", len(png()) + 2)] and bytes(got[1]["carved"][0]["bytes"]) == samples()["image/gif"]
    assert (got[2]["found_type"], got[2]["confirmed"], got[3]["found_type"]) == ("a/b", False, None) and got[4]["confirmed"] and not got[4]["corrected"] and not got[4]["carved"]


def test_stored_texts(odd, none):
    got = media.read_media(media.sniff(media.stored_media(odd))).collect()
    assert len(got) == len(ODD)
    texts = {d: (t or "").encode() for d, t, _ in ODD}
    for r in got:
        t = texts[r["doc_id"]]
        payload = t + b" " * (-len(t) % 192 if t else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(payload) + 44 and r["feature"].startswith("audio/wav;samples=")
    assert media.read_media(media.sniff(media.stored_media(none))).count() == media.store_and_read(none).count() == 0
    clash = odd.withColumn("media", F.lit(1)).withColumn("key", F.lit(2))
    assert sorted(media.store_and_read(clash).collect(), key=str) == sorted(got, key=str)
    assert {(r["found_type"], r["corrected"]) for r in got} == {("audio/wav", True)}


# Pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = documents(4, 120)
    docs = spark.createDataFrame([(k, f"{t} zorkish" if k % 9 == 0 else t, s) for k, t, s in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 9 == 0)) for k, _, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name == "toxicity":
            assert out.filter("text LIKE '%zorkish%'").count() == 0 and out.count() == docs.filter("text NOT LIKE '%zorkish%'").count()
        if name == "exact dedup":
            assert out.count() == out.select("text").distinct().count() == now.select("text").distinct().count()
        if name == "near dedup":
            component, _ = brute([tuple(r) for r in now.collect()])
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(component.values()))
        if name == "mixing":
            assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in now.collect()}
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
    assert out.count() == now.count() and json.dumps(out.columns)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
