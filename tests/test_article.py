"""Main content: planted articles among navigation, and sums over the tree against recursive ones."""

import random

import pytest

from pagewright.sources import article
from pagewright.sources.html import Builder, is_noise, parse_page

WORDS = [f"word{i}" for i in range(500)]


def tree(html):
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def sentence(rng, n=24):
    w = rng.choices(WORDS, k=n)
    return (" ".join(w[: n // 2]) + ", " + " ".join(w[n // 2 :])).capitalize() + "."


def menu(rng, mark, n=12, tag="ul"):
    links = [f'<a href="/{mark}{i}">{mark} {rng.choice(WORDS)} {rng.choice(WORDS)}</a>' for i in range(n)]
    return f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>" if tag == "ul" else f"<div>{' | '.join(links)}</div>"


def planted(seed):
    """A page without `main` or `article`, and the words of its article."""
    rng = random.Random(seed)
    paragraphs = [" ".join(sentence(rng) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 8))]
    inner = "".join(f"<{t}>{p}</{t}>" for p, t in zip(paragraphs, (rng.choice(["p", "p", "p", "div", "blockquote"]) for _ in paragraphs)))
    inside = [f'<div class="related">{menu(rng, "NOISE", 5)}</div>', f'<div class="share-bar">{menu(rng, "NOISE", 3, "div")}</div>', menu(rng, "NOISE", 9)]
    parts = inner.split("</p>")
    if rng.random() < 0.5 and len(parts) > 2:
        parts[len(parts) // 2] = rng.choice(inside) + parts[len(parts) // 2]
    body = f"<h1>Head {seed}</h1>" + "</p>".join(parts)
    for _ in range(rng.randint(0, 3)):
        body = f'<div{rng.choice(["", " class=wrap", " id=content"])}>{body}</div>'
    noise = [
        f'<div class="top">{menu(rng, "NOISE", 20, "div")}{menu(rng, "NOISE", 15)}</div>', f'<div class="sidebar"><p>NOISE {sentence(rng)}</p>{menu(rng, "NOISE", 6)}</div>', f"<div><div>{menu(rng, 'NOISE', 30)}</div></div>",
        f'<div id="comments"><p>NOISE {sentence(rng)}</p></div>', "<script>var NOISE = '<p>NOISE</p>';</script>", f'<div hidden><p>NOISE {sentence(rng, 60)}</p></div>', f"<aside><p>NOISE {sentence(rng, 80)}</p></aside>",
    ]
    rng.shuffle(noise)
    cut = rng.randint(1, len(noise) - 1)
    return f"<html><head><title>T</title></head><body>{''.join(noise[:cut])}<div class=holder>{body}</div>{''.join(noise[cut:])}</body></html>", f"Head {seed} " + " ".join(paragraphs)


@pytest.mark.parametrize("seed", range(80))
def test_planted_articles_are_found_whole(seed):
    html, words = planted(seed)
    got = parse_page(html, "https://h.de/x")
    plain = got["markdown"].replace("# ", "", 1).replace("> ", "")
    assert got["article"] and "NOISE" not in plain
    assert sorted(plain.split()) == sorted(words.split())
    assert got["description"] and words.startswith(f"Head {seed} {got['description']}")


def test_article_shapes():
    page = lambda inner: f"<html><head><title>Doc</title></head><body><nav>navnav</nav>{inner}<footer>footfoot</footer></body></html>"
    prose = "This is a paragraph of meaningful content. " * 30
    got = parse_page(page(f"<article><h1>The Real Title</h1><p>{prose}</p><p>{'More prose here. ' * 40}</p></article>"), "https://h.de")
    assert got["article"] and "meaningful content" in got["markdown"] and "The Real Title" in got["markdown"] and not {"navnav", "footfoot"} & set(got["markdown"].split())
    assert got["description"] == prose.strip()
    tiny = parse_page(page("<main><p>tiny</p></main>"), "https://h.de")
    assert not tiny["article"] and tiny["markdown"] == "tiny\n" and tiny["description"] is None
    # Two halves of one article, and prose left open.
    halves = parse_page(page(f"<div id=a><div class=x><p>one {prose}</p></div><div class=y><p>two {prose}</p></div></div><div class=menu><p>{'<a href=/x>away</a> ' * 50}</p></div>"), "https://h.de")
    assert "one This" in halves["markdown"] and "two This" in halves["markdown"] and "away" not in halves["markdown"]
    opened = parse_page(page(f"<div><h1>H</h1><p><b>bold {prose}<p>next {prose}<p>last {prose}</div>"), "https://h.de")
    assert all(w in opened["markdown"] for w in ("# H", "bold", "next", "last"))
    listed = parse_page(page("<div>" + "".join(f"<li>{prose}</li>" for _ in range(3)) + "</div>"), "https://h.de")
    assert not listed["article"]
    signed = parse_page(page(f'<div><p class="byline">Ann Author</p><p>{prose}</p><p>{prose}</p></div>'), "https://h.de")
    assert signed["author"] == "Ann Author"


def test_page_is_left_as_it_was_and_deep_pages_work():
    html, _ = planted(3)
    root = tree(html)
    before = [(x.tag, len(x.kids)) for x in root.all()]
    from pagewright.sources.html import Node

    assert article.main_content(root, is_noise, Node)
    assert [(x.tag, len(x.kids)) for x in root.all()] == before
    deep = "<div>" * 400 + "<p>" + "deep prose, " * 100 + "</p>" + "</div>" * 400
    assert article.main_content(tree(deep), is_noise, Node)
    assert article.main_content(tree(""), is_noise, Node) is None


def test_sums_match_recursive_ones():
    def measure(node):
        chars, links = len(" ".join("".join(k for k in node.kids if isinstance(k, str)).split())), 0
        for k in node.kids:
            if not isinstance(k, str) and not is_noise(k) and k.tag not in article.NEVER:
                c, n = measure(k)
                chars, links = chars + c, links + n
        return chars, chars if node.tag == "a" and node.attrs.get("href") else links

    for seed in range(5):
        root = tree(planted(seed)[0])
        page = article.Measured(root, is_noise)
        for i, node in enumerate(page.nodes):
            assert (page.chars[i], page.links[i]) == measure(node)
            assert i == 0 or page.parent[i] < i


def test_main_content_reads_references_as_its_sql_does(spark, tmp_path):
    """Titles are cut anywhere, so also inside a reference; what the SQL leaves as text stays text."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    prose = "This is a paragraph of plain and meaningful content. " * 12
    odd = ["&quot", "&quo", "&quot;", "&amp", "&amp;", "&am", "&", "&amp;quot;", "&ampquot;", "&ltx", "&lt;b&gt;", "&copy;", "&copy", "&#39;", "&nbsp;x"]
    page = "<html><body><nav><a href='/a?x=1&copy=2'>away</a></nav><article><h1>token = {0}</h1><p>{1}{0}</p><p>{1}</p></article><footer>&copy; h &middot; x</footer></body></html>"
    rows = [(i, f"https://h.de/{i}", page.format(x, prose)) for i, x in enumerate(odd)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in entry.queries()["main_content"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(f"select page_id, text from ({entry.oracle_sql()['main_content']})").fetchall()) and len(got) == len(odd)


@pytest.mark.parametrize("footer", ["&copy; blog.example.net", "All rights, all marks, all names and all words are ours, and yours, and theirs. " * 2])
def test_lines_with_commas_around_prose_without_any_stay_out(footer):
    words = "word " * 300
    page = f'<html><body><div><ul><li><a href="/a">away</a></li></ul></div><div class="ad">Buy this, that, and what is left of it.</div><div><h1>Head</h1><p><b>{words}<br><p>{"last " * 10}</p></div><div>{footer}</div></body></html>'
    got = parse_page(page, "https://h.de/x")
    assert got["article"] and got["markdown"].replace("*", " ").split() == ["#", "Head", *words.split(), *["last"] * 10]
    # An element with paragraphs of its own stays whole.
    prose = "This is a paragraph of meaningful content. " * 30
    own = parse_page(f"<html><body><div><p>First words, and more of them.</p><div><p>{prose}</p></div></div></body></html>", "https://h.de/x")
    assert "First words" in own["markdown"] and "meaningful" in own["markdown"]
