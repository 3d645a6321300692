"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from vitaframe.llm import bpe, chat, exact, extendible, html, langid, lattice, mixing, shards, simhash, urls
from vitaframe.llm.components import components
from vitaframe.llm.queries import RANKS

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, size string, fp string, `a.b` int"


def docs_of(spark, texts, source=lambda i: "s", lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), source(i), 0, "r", "z", "f", 1) for i, t in enumerate(texts)], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_mixture_against_brute_force(spark):
    rng = random.Random(1)
    names = [None, "a", "b", "é", "z"]
    texts = [None, "", *[" ".join(["w"] * rng.randint(1, 60)) for _ in range(300)]]
    docs = docs_of(spark, texts, source=lambda i: names[i % 5] if i % 4 else "a")
    rows = mixing.mixed(mixing.sizes(docs)).collect()
    assert len(rows) == len(texts)
    size = {}
    for r in rows:
        assert r.size == len((texts[r.id] or "").split()) and r.taken <= 3 * r.size and r.taken == r.size * r.copies
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        share = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and weight[s] * share > 3 * size[s]}
        if not more:
            break
        capped |= more
    for r in rows:
        assert r.target == pytest.approx(3 * size[r.source] if r.source in capped else weight[r.source] * share)
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in size}
    target = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in size)
    again = {r.id: r.taken for r in mixing.mixed(mixing.sizes(docs.repartition(5))).collect()}
    assert again == {r.id: r.taken for r in rows}
    emitted = mixing.mix(docs)
    assert emitted.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in emitted.groupBy("doc_id").count().collect()}
    assert counts == {r.id: r.copies for r in rows if r.copies}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_bpe_equals_the_rank_file_and_returns(spark):
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = [None, "", " ", "Hello, world's  end \n\n x", "naïve 日本 👩‍👩‍👧 <|endoftext|>", "x" * 900, "ab cd\n" * 30_000, "é" * 70_000]
    rows = {r.doc_id: r for r in bpe.round_trip(docs_of(spark, texts), RANKS).withColumnRenamed("id", "doc_id").collect()}
    for i, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    tokens = bpe.encode(docs_of(spark, texts), RANKS)
    back = {r.id: r for r in bpe.decode(tokens, RANKS).collect()}
    assert [back[i].text for i in range(len(texts))] == [t or "" for t in texts]
    for r in tokens.collect():
        ends = list(itertools.accumulate(len(b) for b in (plain.decode_single_token_bytes(i) for i in r.ids)))
        text = texts[r.id] or ""
        if text.isascii():
            assert list(r.ends) == ends and list(r.starts) == [0, *ends[:-1]][: len(ends)]
    cut = spark.createDataFrame([(1, plain.encode_ordinary("👩")[:1]), (2, None)], "id long, ids array<int>")
    assert {r.id: r.text for r in bpe.decode(cut, RANKS).collect()} == {1: "�", 2: ""}


def test_url_rules_and_trees(spark):
    rows = [
        ("http://A.Example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
        ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("https://x.com/de/a#b/c", "x.com", "/de/a", "com/de/", "block"),
        ("http://example.org", "example.org", "", None, None),
        ("no url", "", "", None, None),
        (None, "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
    ]
    many = [(100 + i, f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}") for i in range(200)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)] + many, "page_id long, url string")
    got = {r.id: r for r in urls.judge(df).collect()}
    assert len(got) == len(rows) + len(many)
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert {r.verdict for r in urls.judge(df.where("page_id = 6")).collect()} == {"allow"}
    assert urls.judge(df.limit(0)).count() == 0


def cheapest(roles):
    best = {0: 0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            for more, _, _, to in chat.steps(state, chat.state_of(role)):
                after[to] = min(after.get(to, 10**9), cost + more)
        best = after
    return min(c + chat.INSERT * len(chat.ENDS[s]) for s, c in best.items())


def test_chat_repair(spark):
    rng = random.Random(3)
    turns, roles = [], {}
    for conv in range(30):
        roles[conv] = [rng.choice(["system", "user", "assistant", "Human", None, "tool"]) for _ in range(rng.randint(1, 40))]
        turns += [(conv, t, r, f"t{t}") for t, r in enumerate(roles[conv])]
    df = spark.createDataFrame([*turns, (None, 0, "user", None)], "conv_id long, turn long, role string, text string")
    whole = {r.conv: r for r in chat.repaired_chats(df).collect()}
    assert whole[None].rendered == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    parts = {}
    for r in chat.repaired_chats(df, part=7).orderBy("part").collect():
        parts.setdefault(r.conv, []).append(r)
    for conv in range(30):
        assert whole[conv].cost == cheapest(roles[conv]) == sum(p.cost for p in parts[conv])
        for text in (whole[conv].rendered, "".join(p.rendered for p in parts[conv])):
            said = [line for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]
            legal = said[1:] if said[0] == "<|system|>" else said
            assert legal == ["<|user|>", "<|assistant|>"] * (len(legal) // 2) and legal
            assert all(f"t{t}\n" in text or f"t{t}<|" in text for t in range(len(roles[conv])))
    assert chat.repaired_chats(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "x" * 200_000, "c", 1.0)] * 2 + [(1, 1, "assistant", "", "c", 1.0)], "conv_id long, turn long, role string, text string, rendered string, cost double")
    row = chat.repaired_chats(odd).first()
    assert row.rendered.count("x") == 400_000 and row.rendered.count("<|assistant|>") >= 1


def test_lattice_links_and_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=x.shape)
    y = x + 0.25 * rng.random((400, 1)) * noise / np.linalg.norm(noise, axis=1)[:, None]
    hot = x[:1] + 0.01 * rng.normal(size=(80, 16))  # more than a crowd
    v = np.concatenate([x, y, hot, 3 * x[5:6], x[7:8]])
    rows = [(i, a.tolist()) for i, a in enumerate(v)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(1000 + i, o) for i, o in enumerate(odd)], "vec_id long, embedding array<double>")
    got = {r.id: r for r in lattice.near_vectors(df).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum()
    found = sum(got[i].n_links for i in range(len(v)))
    assert found <= want and found >= 0.99 * want
    assert all(got[i].n_links <= linked[i].sum() for i in range(len(v)))
    assert len({got[i].component for i in range(800, 880)} | {got[0].component}) == 1 and got[7].component == got[881].component == 7
    for i in range(len(odd)):
        assert (got[1000 + i].n_links, got[1000 + i].component, got[1000 + i].kept) == (0, 1000 + i, True)
    assert lattice.near_vectors(df.limit(0)).count() == 0
    twins = spark.createDataFrame([(7, [1.0, 0.0], "n", 1)] * 2 + [(3, [1.0, 0.01], "n", 1), (9, [0.0, 1.0], "n", 1)], "vec_id long, embedding array<double>, node string, weight int")
    found = sorted((r.id, r.n_links, r.component, r.kept) for r in lattice.near_vectors(twins).collect())
    assert found == [(3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False), (9, 0, 9, True)]


def test_shards_fit(spark):
    rng = random.Random(2)
    texts = [None, "", "x" * 5000, *["y" * rng.randint(0, 400) for _ in range(300)]]
    rows = shards.shards(docs_of(spark, texts), 1000).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.shard, []).append(r)
    assert len(rows) == len(texts)
    for name, members in groups.items():
        assert sum(r.n_bytes for r in members) == members[0].shard_bytes and len(members) == members[0].shard_docs
        assert members[0].shard_bytes <= 1000 or len(members) == 1
        assert members[0].depth == len(name) and not any(o != name and o.startswith(name) for o in groups)
    parents = {name[:-1] for name in groups if name}
    for parent in parents:  # nothing was split that fitted
        below = [r for name, m in groups.items() if name.startswith(parent) for r in m]
        assert sum(r.n_bytes for r in below) > 1000 and len(below) > 1
    copies = docs_of(spark, ["z" * 300] * 40).withColumn("doc_id", F.lit(7).cast("long"))
    assert max(r.shard_bytes for r in shards.shards(copies, 1000).collect()) <= 1000
    assert shards.shards(docs_of(spark, []), 1000).count() == 0


def plain_print(text, k):
    import xxhash

    w = lower(text).encode().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def roots(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_against_brute_force(spark):
    rng = random.Random(4)
    base = [f"word{i}" for i in range(300)]
    texts = [None, "", "  \t", "One", "one TWO", "one two three four"]
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(300)] = f"other{rng.randrange(9)}"
        texts.append(" ".join(words))
    prints = [plain_print(t, 3) for t in texts]
    want = roots(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2])
    docs = docs_of(spark, texts)
    got = {r.id: r for r in simhash.simhash_components(docs).collect()}
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == prints
    assert [got[i].component for i in range(len(texts))] == want
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_crowded_fingerprints_lose_no_pair(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 250:
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(40), rng.randint(1, 3))))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.close_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {(r.a, r.b) for r in found.collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and len(want) > 1000


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1050)}


def test_exact_duplicates(spark):
    texts = [None, "", "Same", "sAME", "SAME", "É", "é", "x" * 200_000, "X" * 200_000, *[f"t{i % 40}" for i in range(200)]]
    docs = docs_of(spark, texts)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    got = {r.id: r for r in exact.exact_duplicates(docs, capacity=5).collect()}
    for t, members in groups.items():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert len({r.bucket for r in got.values()}) > 5
    kept = exact.one_of_each_text(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(m) for m in groups.values())
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_directory_splits_only_overfull_prefixes(spark):
    rows = spark.range(500).select(F.col("id").alias("h"), F.lit(1).alias("weight"))  # all share 51 leading bits
    found = extendible.assign(rows, 40).collect()
    assert len(found) == 500 and max(r.bucket_weight for r in found) <= 40 and min(r.depth for r in found) >= 51


PAGE = "<html><head><title>T</title></head><body>{}</body></html>"


def test_main_text(spark):
    story = lambda page: "".join(f"<p>{' '.join(f'w{page}x{i}y{k}' for k in range(12))} &amp; end</p>" for i in range(3))
    menu = "<div>Home Products Services About us Contact and imprint today</div>"
    rows = [
        (1, "http://a.org/1", PAGE.format("<nav>Menu</nav><article><header><h1>Title</h1><p>by X</p></header><p>One <b>t</b>wo<br>three<p>Four&nbsp;five"
                                          "<aside>Side</aside><div class='ad-box'>Buy</div><script>x('</p>')</script><div id='comments'>Hi</div></article><footer>F</footer>")),
        (2, "http://b.org/1", PAGE.format(menu + story(2))),
        (3, "http://b.org/2", PAGE.format(menu + story(3))),
        (4, "http://b.org/3", PAGE.format(menu + story(3))),
        (5, None, None),
        (6, "x", ""),
        (7, "http://c.org", "<body class='with-sidebar'><form><main><p class=ad>No<p>Yes</main></form><div class=cookie-notice>C</div>"),
        (8, "http://c.org", "<article class=comment>No</article><div class='post-content'>Text<form>F</form></div><p>after"),
    ]
    got = {r.id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Title One two three Four five" and got[1].n_chars == len(got[1].text)
    for i in (2, 3):
        assert got[i].text == " ".join(f"{' '.join(f'w{i}x{n}y{k}' for k in range(12))} & end" for n in range(3))
    assert got[4].text == got[3].text and got[5].text == got[6].text == "" and got[5].url is None
    assert got[7].text == "Yes" and got[8].text == "Text"


def test_runs_that_a_host_repeats_go_from_articles_too(spark):
    story = lambda i: " ".join(f"s{i}w{k}" for k in range(30))
    notice = "Sign up now for our weekly letter and never miss any news"
    shared = "this passage of ten words stands in two articles only"
    page = lambda i, more: PAGE.format(f"<article><p>{story(i)}</p><p>{notice}</p><p>{more}own{i} {notice}</p></article>")
    rows = [(i, f"http://n.org/{i}", page(i, shared + " " if i < 2 else "")) for i in range(4)]
    rows += [(10 + i, "http://two.org/", PAGE.format(f"<article><p>{story(10 + i // 2)}</p><p>{notice}</p></article>")) for i in range(4)]  # two contents
    rows += [(20 + i, "http://w.org/", PAGE.format(f"<div class=content><p>{story(20 + i)}</p><p>{notice}</p></div>")) for i in range(3)]
    got = {r.id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(4)] == [f"{story(i)} {shared + ' ' if i < 2 else ''}own{i}" for i in range(4)]
    assert [got[10 + i] for i in range(4)] == [f"{story(10 + i // 2)} {notice}" for i in range(4)]
    assert [got[20 + i] for i in range(3)] == [story(20 + i) for i in range(3)]


def test_language_backoff_and_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs)
    judged = langid.with_language(docs, model).select(langid.held_out(F.col("_row.doc_id")).alias("h"), F.col("_row.lang").alias("lang"), "lang_pred", "score")
    rows = [r for r in judged.collect() if r.h]
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = docs_of(spark, [None, "", "12 ²½ !!", "a", "x" * 300_000])
    got = {r._row.doc_id: r for r in langid.with_language(odd, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[3].lang_pred in model.languages and got[4].lang_pred in model.languages
    kept = langid.of_known_language(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
    empty = langid.train(docs.limit(0))
    assert langid.with_language(odd, empty).where("lang_pred <> 'und'").count() == 0
    counts = langid.words("Aß aß É²x 7")
    assert counts == {"aß": 2, "éx": 1} and langid.grams("ab", 3) == ["<ab", "ab>"]


def test_pipeline_stages_against_brute_force(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.upper("text"))
    odd = docs.limit(2).withColumn("doc_id", -F.col("doc_id") - 1).withColumn("text", F.lit(None).cast("string"))
    table = docs.unionByName(extra).unionByName(odd)
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = table
        table = stage(spark, before, data)
        if name != "tokens":
            assert table.columns == docs.columns
        rows[name] = table.collect()
        if name != "tokens":
            table = spark.createDataFrame(rows[name], docs.schema)
    assert {r.doc_id for r in rows["language"]} == {r.doc_id for r in docs.unionByName(extra).collect()}
    texts = {}
    for r in rows["language"]:
        texts[lower(r.text)] = max(texts.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in rows["exact_copies"]) == sorted(texts.values())
    left = sorted(rows["exact_copies"], key=lambda r: r.doc_id)
    # near copies: fingerprints of three-word shingles with at most 2 differing bits
    prints = [plain_print(r.text, 3) for r in left]
    near = roots(len(left), [(a, b) for a, b in itertools.combinations(range(len(left)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2])
    assert sorted(r.doc_id for r in rows["near_copies"]) == [left[i].doc_id for i in sorted(set(near))]
    assert {r.doc_id for r in rows["mixture"]} <= {r.doc_id for r in rows["near_copies"]}
    assert sorted(r.doc_id for r in rows["tokens"]) == sorted(r.doc_id for r in rows["mixture"])
    by_id = {r.doc_id: r.text for r in rows["mixture"]}
    assert all(r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest() for r in rows["tokens"])
