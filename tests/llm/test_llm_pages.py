import numpy as np
import pytest

from tickerloom.llm import pages
from tickerloom.llm.pages import blocks_of, extract_text, main_texts, repeated_tokens

SCHEMA = "page_id long, url string, html string, host int, text string, place string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", "y") for i, u, h in rows], SCHEMA)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<nav><ul><li><a>menu</a></li></ul></nav><article><h1>Head</h1><p>One  two\n three</p></article><footer>f</footer>", "Head\nOne two three"),
        ("<article><p><b>open<br><p>next &amp; &lt;b&gt; &#233;&eacute; &amp</article>", "open\nnext & <b> éé &"),
        ("<div class='ad'>x</div><main><p>a</p><div class='share-buttons'>x</div><aside>x</aside><p>b</p></main>", "a\nb"),
        ("<article><header><h1>Kept</h1></header><p>t</p><section id='comments'><p>me too</p></section><form>x<input></form></article>", "Kept\nt"),
        ("<header>site</header><div role='navigation'>x</div><article>t<!-- c --><footer>x</footer></article><article class='comment'>x</article>", "t"),
        ("<nav><ul><li>never closed<article><p>t</p></article>", "t"),
        ("<p>no article</p><p>but text</p>", "no article\nbut text"),
        ("<article><p>a<span> b</span></p>c<p hidden>x</p><p style='display: none'>x</p></article>", "a b\nc"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x</td><td>y</td></tr></table><hr/>z</article>", "one\ntwo\nx\ny\nz"),
        ("<article></article>", ""),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ],
)
def test_blocks(body, text):
    assert main_texts([page(body)]) == [text]


def test_truncated_and_empty_pages():
    whole = page("<article><p>one</p><p>two</p></article>")
    for end in range(len(whole)):
        main_texts([whole[:end]])
    assert main_texts([None, "", "<", "&", "plain text"]) == ["", "", "<", "&", "plain text"]


def test_runs_repeated_over_pages_go():
    notice = " ".join(f"n{i}" for i in range(15))
    rows = [page(f"<div>{notice}</div><div>own words of page {i} " + " ".join(f"u{i}x{j}" for j in range(20)) + "</div>") for i in range(4)]
    out = main_texts(rows)
    assert all("n3" not in t and f"u{i}x19" in t for i, t in enumerate(out))
    assert all("n3" in t for t in main_texts(rows[:2]))  # two pages are too few
    inside = [page(f"<article><p>{notice}</p><p>u{i}</p></article>") for i in range(4)]
    assert main_texts(inside) == [f"{notice}\nu{i}" for i in range(4)]


@pytest.mark.parametrize("seed", range(8))
def test_repeated_runs_match_brute_force(seed):
    chance = np.random.default_rng(seed)
    run, least = int(chance.integers(1, 7)), int(chance.integers(2, 4))
    streams = [chance.integers(0, 3, int(chance.integers(0, 50))) for _ in range(7)]
    found = repeated_tokens(streams, run, least)
    for own, hit in zip(streams, found, strict=True):
        want = np.zeros(len(own), bool)
        for at in range(len(own) - run + 1):
            part = own[at : at + run]
            if sum(any((part == s[b : b + run]).all() for b in range(len(s) - run + 1)) for s in streams) >= least:
                want[at : at + run] = True
        assert hit.tolist() == want.tolist()


def test_table(spark):
    long = "<article>" + "<p>word</p>" * 60_000 + "</article>"
    rows = [(1, "http://a.example/x", page("<article><p>é one</p></article>")), (2, None, None), (3, "no url", ""), (None, "https://b.example", page("<p>t</p>")), (4, "http://a.example", long), (4, "http://a.example", long)]
    found = sorted((tuple(r) for r in extract_text(table(spark, rows)).collect()), key=str)
    assert found == sorted([(1, "http://a.example/x", "é one", 5), (2, None, "", 0), (3, "no url", "", 0), (None, "https://b.example", "t", 1)] + [(4, "http://a.example", "\n".join(["word"] * 60_000), 299_999)] * 2, key=str)
    assert extract_text(table(spark, [])).collect() == []


def test_large_host_is_searched_in_shares(spark, monkeypatch):
    rows = [(i, "http://a.example/%d" % i, page(f"<article><p>t{i}</p></article>")) for i in range(50)]
    batches = list(pages._extract(iter([pages.pa.RecordBatch.from_pylist([{"host": "a", "page_id": i, "url": u, "html": h} for i, u, h in rows])])))
    assert sum(b.num_rows for b in batches) == 50
    monkeypatch.setattr(pages, "SHARE_PAGES", 7)
    batches = list(pages._extract(iter([pages.pa.RecordBatch.from_pylist([{"host": "a", "page_id": i, "url": u, "html": h} for i, u, h in rows])])))
    assert max(b.num_rows for b in batches) == 7 and sum(b.num_rows for b in batches) == 50


def test_supplied_pages_hold_their_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    for r in extract_text(df).collect():
        inner = html[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text == "\n".join(t for t, _ in blocks_of(inner))


def test_shares_give_the_same_as_the_whole_host(spark, monkeypatch):
    notice = " ".join(f"n{i}" for i in range(15))
    rare = " ".join(f"r{i}" for i in range(14))
    own = lambda i: " ".join(f"u{i}x{j}" for j in range(20))
    body = lambda i: f"<p>{notice}</p><p>{own(i)}</p>" + (f"<p>{rare}</p>" if i % 20 == 0 else "")
    html = [page(f"<article>{body(i)}</article>" if i % 9 == 4 else body(i)) for i in range(50)]
    rows = [(i, "http://a.example/%d" % i, h) for i, h in enumerate(html)]
    rows += [(100 + i, "http://b.example/%d" % i, page(body(i))) for i in range(2)]  # two pages are too few, also beside another host's
    want = dict(enumerate(main_texts(html))) | dict(zip((100, 101), main_texts([r[2] for r in rows[50:]]), strict=True))
    assert "r3" not in want[0] and "n3" not in want[48] and "n3" in want[4] and "n3" in want[100]
    for share in (1, 7, 49, 400):
        monkeypatch.setattr(pages, "SHARE_PAGES", share)
        extract = pages._extract
        ids = {}
        out = list(extract(iter([pages.pa.RecordBatch.from_pylist([{"host": "a", "page_id": i, "url": u, "html": h} for i, u, h in rows[:50]])])))
        tallied = pages.pa.Table.from_batches([b for batch in out for b in pages._tally(1)(iter([batch]))])
        common = pages._common(tallied)
        for batch in out:
            table_of = pages.pa.Table.from_batches([batch])
            table_of = table_of.filter(table_of["bare"])
            if not len(table_of):
                continue
            mine = common.filter(pages.pa.compute.equal(common["share"], table_of["share"][0]))
            ids |= {r["page_id"]: r["text"] for r in pages._without(table_of, mine).to_pylist()}
        assert ids == {i: want[i] for i in range(50) if i % 9 != 4}
    found = {r.page_id: r.text for r in extract_text(table(spark, rows)).collect()}
    assert found == want


def test_host_of_one_page_more_than_a_share(spark):
    notice = " ".join(f"n{i}" for i in range(15))
    rows = [(i, f"http://a.example/{i}", page(f"<p>{notice}</p><p>own{i}</p>")) for i in range(401)]
    assert {r.page_id: r.text for r in extract_text(table(spark, rows)).collect()} == {i: f"own{i}" for i in range(401)}


def test_runs_judge_pages_with_text_beside_their_article(spark):
    notice = " ".join(f"n{i}" for i in range(40))
    own = lambda i: " ".join(f"u{i}x{j}" for j in range(30))
    teased = [page(f"<article><p>teaser {i}</p></article><div>{notice}</div><div>{own(i)}</div>") for i in range(4)]
    whole = [page(f"<div>{notice}</div><article><p>{own(i)}</p></article><p>by line {i}</p>") for i in range(4, 8)]
    want = [f"teaser {i}\n{own(i)}" for i in range(4)] + [own(i) for i in range(4, 8)]
    assert main_texts(teased + whole) == want
    rows = [(i, f"http://a.example/{i}", h) for i, h in enumerate(teased + whole)]
    # what the host repeats beside an article makes it no teaser, what is the page's own does
    short = page(f"<article><p>{' '.join(f's{j}' for j in range(9))}</p></article><div>{notice}</div>")
    rows += [(8, "http://a.example/8", short), (9, "http://b.example/9", short)]
    want += [" ".join(f"s{j}" for j in range(9)), " ".join(f"s{j}" for j in range(9)) + "\n" + notice]
    assert {r.page_id: r.text for r in extract_text(table(spark, rows)).collect()} == dict(enumerate(want))


def test_every_page_goes_through_the_runs_of_its_host(spark, monkeypatch):
    tally, seen = pages._tally, spark.sparkContext.accumulator(0)

    def watched(buckets):
        inner = tally(buckets)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return lambda batches: inner(count(batches))

    monkeypatch.setattr(pages, "_tally", watched)
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(f"<article><p>text of page {i}</p></article>")) for i in range(30)]
    assert {r.page_id: r.text for r in extract_text(table(spark, rows)).collect()} == {i: f"text of page {i}" for i in range(30)}
    assert seen.value == 30


def test_hosts_of_a_share_and_tasks_are_counted_apart(spark, monkeypatch):
    notice = " ".join(f"n{i}" for i in range(15))
    body = lambda i: f"<p>{notice}</p><p>u{i} v{i}</p>"
    # host a has the notice beside one article only: two pages in articles of their own make three; host b has two in all
    html = [body(0), f"<article>{body(1)}</article>", f"<article>{body(2)}</article>", body(3), f"<article>{body(4)}</article>"]
    rows = [(i, f"http://{'aaabb'[i]}.example/{i}", page(h)) for i, h in enumerate(html)]
    whole = lambda i: f"{notice}\nu{i} v{i}"
    want = {0: "u0 v0"} | {i: whole(i) for i in range(1, 5)}
    for parts in (1, 5):
        assert {r.page_id: r.text for r in extract_text(table(spark, rows).repartition(parts)).collect()} == want


def test_packed_names_come_back():
    for n in (0, 1, 5, 1000):
        names = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64) & pages._SHORT)
        assert (pages._unpacked(pages._packed(names[::-1])) == names).all()
