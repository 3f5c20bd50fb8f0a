"""HTML extraction and the URL filter."""

import html as entities
import re
from urllib.parse import urlsplit

import pytest

from millrace.llm import html, urls
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def article_by_force(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_articles_of_the_table(pages):
    got = {r["page_id"]: r for r in html.page_texts(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        text = article_by_force(r["html"])
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text) and got[r["page_id"]]["url"] == r["url"]


LONG = "This paragraph has quite a few words, as the running text of an article does, and so it counts."
CASES = {
    "furniture around an article": (f"<nav><a href=/>Home</a></nav><header>Site</header><article><header><h1>Title</h1></header><p>Short.<p>{LONG}</article><aside>Side {LONG}</aside><footer>Foot</footer>", ["Title", "Short.", LONG]),
    "notices, adverts, forms and comments inside it": (f"<article><h1>T</h1><div class='ad'>Buy {LONG}</div><p>{LONG}</p><div id=cookie-notice><p>Cookies {LONG}</div><form><label>Mail {LONG}</label></form><section class='comments'><article class=comment><p>First! {LONG}</p></article></section></article>", ["T", LONG]),
    "a reader comment is no article": (f"<main><p>{LONG}</p><div class='comment-list'><article><p>me too {LONG} {LONG}</article></div></main>", [LONG]),
    "scripts, styles, comments, references": (f"<article><style>p{{}}</style><script>if (a < b) {{ '</p>' }}</script><!-- {LONG} --><p>A &amp;&lt;b&gt; &eacute;&#233; caf&#xe9;&nbsp;x</p></article>", ["A &<b> éé café x"]),
    "white space and breaks": ("<article><p>  one\n\t two<br>three <b>fo</b>ur</p>\n<p> </p>five</article>", ["one two three four", "five"]),
    "no article: surge and dive": (f"<ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About us and our friends and all of their many many friends</a></ul><div><h2>Head</h2><p>{LONG}<p>{LONG}<p>End.</div><ul><li><a href=/d>Next</a><li><a href=/e>Last</a><li><a href=/f>More</a><li><a href=/g>Imprint</a></ul>", None),
    "unclosed advert": (f"<body><div class=ad>Buy<p>{LONG}<p>{LONG}", None),
    "furniture alone": ("<nav>a</nav><footer>b</footer>", []),
    "cut off inside a tag": (f"<article><p>{LONG}</p><p class=\"x", [LONG]),
    "lists, tables and quotes": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><blockquote>e<p>f</blockquote><dl><dt>g<dd>h</dl></article>", list("abcdefgh")),
    "odd quotes": ("<article><p title='a > b'>x</p><p title=\"y>z</p>\">w</p></article>", ["x", "w"]),
    "plain text": ("", []),
}


@pytest.mark.parametrize("case", CASES)
def test_extraction(case):
    page, blocks = CASES[case]
    text = html.main_text(page)
    if blocks is None:
        assert LONG in text and "Home" not in text and "Imprint" not in text
    else:
        assert text.split("\n\n") == blocks or (text == "" and not blocks)


def test_extraction_awkward(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (None, "u", "<article>" + "<p>a</p>" * 50_000, "t"), (4, "u", "<" * 20_000, "t"), (5, "u", "<div>" * 3000 + LONG, "t")], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == 6 and sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0]
    assert next(r for r in got if r["page_id"] is None)["n_chars"] == 50_000 * 3 - 2
    assert next(r for r in got if r["page_id"] == 5)["text"] == LONG
    assert html.page_texts(df.limit(0)).count() == 0


def rule_by_force(host, path):
    fits = [(len(h + p), h + p, say) for say, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_against_brute_force(spark, pages):
    odd = ["HTTP://Example.COM/EN/x", "http://WWW.example.com/en/?q", "http://www.example.com/en", "http://a.www.example.com/en/1#x", "x://net/es/", "x://inet/es/", "http://example.com?a/b", "http://example.com#/en/", "http://com/", "nothing", "", "a://", "//x/y", "http://ÄB.com/É?x://y", "http://x.com/a://b.net/es/"]
    df = pages.select("page_id", "url").union(spark.createDataFrame(list(enumerate(odd, 10**6)) + [(None, None), (7, None)], "page_id long, url string"))
    got = urls.page_verdicts(df).collect()
    assert len(got) == df.count()
    want = sorted((r["page_id"] or -1, *parse(r["url"])) for r in df.collect())
    assert sorted((r["page_id"] or -1, r["host"], r["path"]) for r in got) == want
    for r in got:
        rule, verdict = rule_by_force(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_parts_agree_with_the_standard_library(pages):
    host, path = urls.host_and_path(pages["url"])
    for r in pages.select("url", host.alias("h"), path.alias("p")).collect():
        parts = urlsplit(r["url"])
        assert (r["h"], r["p"]) == (parts.netloc, parts.path)


def test_models_tell_labelled_urls_apart(spark):
    rows = [(k, f"good{k % 7}.org/news/{k}", "allow") for k in range(300)] + [(k, f"pills{k % 5}.biz/buy/{k}", "block") for k in range(300)]
    model = urls.fit(spark.createDataFrame(rows, "k long, said string, verdict string"))
    import pyarrow as pa
    fresh = model.score(pa.array(["good3.org/news/9999", "pills2.biz/buy/777", ""]))
    assert fresh[0] > model.threshold > fresh[1]


def test_url_scores_against_brute_force(spark):
    """Without hash collisions the arrays hold the plain Witten-Bell recursion."""
    import math
    from collections import Counter, defaultdict
    rows = [(f"ab{k % 3}/c{k % 4}", "allow" if k % 2 else "block") for k in range(400)]
    df = spark.createDataFrame(rows, "said string, verdict string")
    model = urls.fit(df)
    aside = {r["said"] for r in df.selectExpr("said", "pmod(xxhash64(said), 5) AS m").collect() if r["m"] == 0}
    import pyarrow as pa
    for text in ("ab1/c2", "zz", "", "ab"):
        total = 0.0
        for sign, label in ((1, "allow"), (-1, "block")):
            grams, contexts, kinds = Counter(), Counter(), defaultdict(set)
            for said, verdict in rows:
                if verdict == label and said not in aside:
                    s = b"\0" * 5 + said.encode() + b"\0"
                    for at in range(5, len(s)):
                        for k in range(6):
                            c = s[at - k:at]
                            contexts[c] += 1
                            grams[c, s[at]] += 1
                            kinds[c].add(s[at])
            s = b"\0" * 5 + text.encode() + b"\0"
            for at in range(5, len(s)):
                p = 1 / 256
                for k in range(6):
                    c = s[at - k:at]
                    if contexts[c] >= urls.CONTEXT_ROWS:
                        p = (grams[c, s[at]] + len(kinds[c]) * p) / (contexts[c] + len(kinds[c]))
                total += sign * math.log(p)
        assert model.score(pa.array([text]))[0] == pytest.approx(total / (len(text) + 1), rel=1e-9)


def test_urls_of_an_empty_table(pages):
    assert urls.page_verdicts(pages.limit(0)).count() == 0
