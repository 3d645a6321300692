"""Runs that a host repeats, against a plain search, and whole articles at every table size."""

import random

import pytest

from vitaframe.llm import html

PAGES = "page_id long, url string, html string, host string, blocks string, place int, `a.b` int"


def page(body, outside=""):
    return f"<html><body><nav>Home About</nav><article>{body}</article>{outside}</body></html>"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def found(spark, rows):
    df = spark.createDataFrame([(i, url, text, "h", "b", 1, 2) for i, (url, text) in enumerate(rows)], PAGES)
    got = html.main_text(df.repartition(3))
    assert got.columns == ["id", "url", "text", "n_chars"]
    out = {r.id: r.text for r in got.collect()}
    return [out[i] for i in range(len(rows))]


def by_hand(rows):
    """Every window of every page is looked for in every different page of its host."""
    read = [html.Reader(text).blocks if text else [] for _, text in rows]
    chosen = [html.chosen(blocks) for blocks in read]
    streams = [[t for b in blocks for t in b.text.split()] for blocks in read]
    hosts = [url.split("://")[1].split("/")[0] if url else "" for url, _ in rows]
    out = []
    for blocks, (kept, article), tokens, host in zip(read, chosen, streams, hosts, strict=True):
        contents = {" ".join(s) for s, h in zip(streams, hosts, strict=True) if h == host}
        windows = [{tuple(c.split()[i : i + html.SPAN]) for i in range(len(c.split()) - html.SPAN + 1)} for c in contents]
        least = max(html.SEVERAL if article else html.FEW, len(contents) // 2 + 1)
        hit = set()
        for i in range(len(tokens) - html.SPAN + 1):
            if sum(tuple(tokens[i : i + html.SPAN]) in w for w in windows) >= least:
                hit.update(range(i, i + html.SPAN))
        left, plain, at = [], [], 0
        for block, stays in zip(blocks, kept, strict=True):
            own = block.text.split()
            if stays:
                plain += own
                rest = [t for i, t in enumerate(own, at) if i not in hit]
                if article or len(own) - len(rest) < html.COVERED * len(own):
                    left += rest
            at += len(own)
        out.append(" ".join(left or plain))
    return out


@pytest.mark.parametrize("n", [20, 200])
def test_shared_sentences_stay_and_notices_of_all_articles_go(spark, n):
    rng = random.Random(n)
    shared, notice = words(rng, 14) + ".", "Sign up for our weekly letter and never miss a new story again."
    bodies = [words(rng, 40) for _ in range(n)]
    rows = [("https://a.org/x", page(f"<p>{b}</p>" + (f"<p>{shared}</p>" if i < 5 else "") + f"<p>{notice}</p><p>{b[::-1]}</p>")) for i, b in enumerate(bodies)]
    got = found(spark, rows)
    assert got == [f"{b} {shared} {b[::-1]}" if i < 5 else f"{b} {b[::-1]}" for i, b in enumerate(bodies)]


def test_random_hosts_as_by_hand(spark, monkeypatch):
    monkeypatch.setattr(html, "GROUP", 4)
    rng = random.Random(7)
    common = [words(rng, k) for k in (7, 8, 9, 15, 30)]
    rows = []
    for host in ("a.org", "b.org", "c.org", "d.org"):
        for _ in range(rng.choice([1, 2, 5, 23])):
            parts = [rng.choice([words(rng, 6), rng.choice(common), rng.choice(common[:3])]) for _ in range(5)]
            body = "".join(f"<p>{p}</p>" for p in parts)
            rows.append((f"https://{host}/", page(body, f"<p>{rng.choice(common)}</p>") if rng.random() < 0.7 else f"<div>{body}</div><p>{rng.choice(common)}</p>"))
    rows += [(None, None), ("https://b.org/", ""), rows[3], rows[3], ("https://b.org/", page("<p>" + words(rng, 3000) + "</p>"))]
    assert found(spark, rows) == by_hand(rows)


def test_copies_count_once_and_empty_table(spark):
    rng = random.Random(9)
    text = page(f"<p>{words(rng, 30)}</p>")
    rows = [("https://a.org/", text)] * 40 + [("https://a.org/", page(f"<p>{words(rng, 30)}</p>"))]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, rows)[0].count(" ") == 29
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0
