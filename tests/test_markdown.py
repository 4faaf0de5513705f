"""The Markdown renderer on the public CommonMark examples, on hostile texts, and as a query."""

import html
import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest

from lexweave.functions import commonmark, markup

# Examples of the public CommonMark specification and cases made after them: text, HTML.
EXAMPLES = [
    ('***a***', '<p><em><strong>a</strong></em></p>\n'),
    ('a  \nb', '<p>a<br />\nb</p>\n'),
    ('Title\n===', '<h1>Title</h1>\n'),
    ('![i](u)', '<p><img src="u" alt="i" /></p>\n'),
    ('__a__b', '<p>__a__b</p>\n'),
    ('\tfoo\tbaz\t\tbim', '<pre><code>foo\tbaz\t\tbim\n</code></pre>\n'),
    ('  - foo\n\n\tbar', '<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n'),
    ('- foo\n\n\t\tbar', '<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>\n'),
    ('>\t\tfoo', '<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>\n'),
    ('-\t\tfoo', '<ul>\n<li>\n<pre><code>  foo\n</code></pre>\n</li>\n</ul>\n'),
    ('- a\n- b\n\n  [ref]: /url\n- d', '<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>d</p>\n</li>\n</ul>\n'),
    ('* a\n  > b\n  >\n* c', '<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n</li>\n<li>c</li>\n</ul>\n'),
    ('- a\n  - b\n\n    c\n- d', '<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n'),
    ('- a\n- ```\n  b\n\n\n  ```\n- c', '<ul>\n<li>a</li>\n<li>\n<pre><code>b\n\n\n</code></pre>\n</li>\n<li>c</li>\n</ul>\n'),
    ('> 1. > Blockquote\ncontinued here.', '<blockquote>\n<ol>\n<li>\n<blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote>\n</li>\n</ol>\n</blockquote>\n'),
    ('-\n\n  foo', '<ul>\n<li></li>\n</ul>\n<p>foo</p>\n'),
    ('-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz', '<ul>\n<li>foo</li>\n<li>\n<pre><code>bar\n</code></pre>\n</li>\n<li>\n<pre><code>baz\n</code></pre>\n</li>\n</ul>\n'),
    ('- foo\n-   \n- bar', '<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>\n'),
    ('foo\n*', '<p>foo\n*</p>\n'),
    ('* Foo\n* * *\n* Bar', '<ul>\n<li>Foo</li>\n</ul>\n<hr />\n<ul>\n<li>Bar</li>\n</ul>\n'),
    ('- Foo\n- * * *', '<ul>\n<li>Foo</li>\n<li>\n<hr />\n</li>\n</ul>\n'),
    ('# foo\t\n', '<h1>foo</h1>\n'),
    ('## foo ##\n  ###   bar    ###', '<h2>foo</h2>\n<h3>bar</h3>\n'),
    ('### foo \\###', '<h3>foo ###</h3>\n'),
    ('## \n#\n### ###', '<h2></h2>\n<h1></h1>\n<h3></h3>\n'),
    ('#5 bolt', '<p>#5 bolt</p>\n'),
    ('Foo\nBar\n---', '<h2>Foo\nBar</h2>\n'),
    ('> Foo\n---', '<blockquote>\n<p>Foo</p>\n</blockquote>\n<hr />\n'),
    ('> foo\nbar\n===', '<blockquote>\n<p>foo\nbar\n===</p>\n</blockquote>\n'),
    ('[foo]: /url\n===\n[foo]', '<p>===\n<a href="/url">foo</a></p>\n'),
    ('[foo]: /url\nbar\n===\n[foo]', '<h1>bar</h1>\n<p><a href="/url">foo</a></p>\n'),
    ('[foo]: /url "title"\n\n[foo]', '<p><a href="/url" title="title">foo</a></p>\n'),
    ("   [foo]: \n      /url  \n           'the title'  \n\n[foo]", '<p><a href="/url" title="the title">foo</a></p>\n'),
    ("[foo]: /url 'title\n\nwith blank line'\n\n[foo]", "<p>[foo]: /url 'title</p>\n<p>with blank line'</p>\n<p>[foo]</p>\n"),
    ('[foo]:\n\n[foo]', '<p>[foo]:</p>\n<p>[foo]</p>\n'),
    ('[foo]: <>\n\n[foo]', '<p><a href="">foo</a></p>\n'),
    ('[foo]: /url "title" ok', '<p>[foo]: /url &quot;title&quot; ok</p>\n'),
    ('[foo]: /url\n"title" ok', '<p>&quot;title&quot; ok</p>\n'),
    ('`` foo ` bar ``', '<p><code>foo ` bar</code></p>\n'),
    ('` `` `', '<p><code>``</code></p>\n'),
    ('`foo   bar \nbaz`', '<p><code>foo   bar  baz</code></p>\n'),
    ('*foo`*`', '<p>*foo<code>*</code></p>\n'),
    ('[not a `link](/foo`)', '<p>[not a <code>link](/foo</code>)</p>\n'),
    ('```foo``', '<p>```foo``</p>\n'),
    ('a * foo bar*', '<p>a * foo bar*</p>\n'),
    ('a*"foo"*', '<p>a*&quot;foo&quot;*</p>\n'),
    ('foo*bar*', '<p>foo<em>bar</em></p>\n'),
    ('foo_bar_', '<p>foo_bar_</p>\n'),
    ('foo-_(bar)_', '<p>foo-<em>(bar)</em></p>\n'),
    ('*(*foo)', '<p>*(*foo)</p>\n'),
    ('*(*foo*)*', '<p><em>(<em>foo</em>)</em></p>\n'),
    ('**foo*bar**', '<p><strong>foo*bar</strong></p>\n'),
    ('*foo**bar**baz*', '<p><em>foo<strong>bar</strong>baz</em></p>\n'),
    ('*foo**bar*', '<p><em>foo**bar</em></p>\n'),
    ('***foo** bar*', '<p><em><strong>foo</strong> bar</em></p>\n'),
    ('foo***bar***baz', '<p>foo<em><strong>bar</strong></em>baz</p>\n'),
    ('foo******bar*********baz', '<p>foo<strong><strong><strong>bar</strong></strong></strong>***baz</p>\n'),
    ('*foo [*bar*](/url)*', '<p><em>foo <a href="/url"><em>bar</em></a></em></p>\n'),
    ('** is not', '<p>** is not</p>\n'),
    ('foo ***', '<p>foo ***</p>\n'),
    ('**foo*', '<p>*<em>foo</em></p>\n'),
    ('****foo*', '<p>***<em>foo</em></p>\n'),
    ('*foo _bar* baz_', '<p><em>foo _bar</em> baz_</p>\n'),
    ('**foo **bar baz**', '<p>**foo <strong>bar baz</strong></p>\n'),
    ('*[bar*](/url)', '<p>*<a href="/url">bar*</a></p>\n'),
    ('**a<https://foo.bar/?q=**>', '<p>**a<a href="https://foo.bar/?q=**">https://foo.bar/?q=**</a></p>\n'),
    ('[link](/uri "title")', '<p><a href="/uri" title="title">link</a></p>\n'),
    ('[link]()', '<p><a href="">link</a></p>\n'),
    ('[link](/my uri)', '<p>[link](/my uri)</p>\n'),
    ('[link](</my uri>)', '<p><a href="/my%20uri">link</a></p>\n'),
    ('[link](foo(and(bar)))', '<p><a href="foo(and(bar))">link</a></p>\n'),
    ('[link]("title")', '<p><a href="%22title%22">link</a></p>\n'),
    ('[link] (/uri)', '<p>[link] (/uri)</p>\n'),
    ('[link [foo [bar]]](/uri)', '<p><a href="/uri">link [foo [bar]]</a></p>\n'),
    ('[foo [bar](/uri)](/uri)', '<p>[foo <a href="/uri">bar</a>](/uri)</p>\n'),
    ('![[[foo](uri1)](uri2)](uri3)', '<p><img src="uri3" alt="[foo](uri2)" /></p>\n'),
    ('[foo *bar](baz*)', '<p><a href="baz*">foo *bar</a></p>\n'),
    ('[foo`](/uri)`', '<p>[foo<code>](/uri)</code></p>\n'),
    ('[foo][bar]\n\n[bar]: /url "title"', '<p><a href="/url" title="title">foo</a></p>\n'),
    ('[foo] [bar]\n\n[bar]: /url', '<p>[foo] <a href="/url">bar</a></p>\n'),
    ('[foo][]\n\n[foo]: /url', '<p><a href="/url">foo</a></p>\n'),
    ('[foo]\n[]\n\n[foo]: /url', '<p><a href="/url">foo</a>\n[]</p>\n'),
    ('[foo][bar][baz]\n\n[baz]: /url', '<p>[foo]<a href="/url">bar</a></p>\n'),
    ('[foo][bar][baz]\n\n[baz]: /url1\n[foo]: /url2', '<p>[foo]<a href="/url1">bar</a></p>\n'),
    ('[foo](not a link)\n\n[foo]: /url1', '<p><a href="/url1">foo</a>(not a link)</p>\n'),
    ('[[bar [foo]\n\n[foo]: /url', '<p>[[bar <a href="/url">foo</a></p>\n'),
    ('!\\[foo]\n\n[foo]: /url', '<p>![foo]</p>\n'),
    ('![foo *bar*]\n\n[foo *bar*]: train.jpg "t"', '<p><img src="train.jpg" alt="foo bar" title="t" /></p>\n'),
    ('&nbsp; &amp; &copy; &#35; &#0; &hi; &x;', '<p>\xa0 &amp; © # � &amp;hi; &amp;x;</p>\n'),
    ('[a](url &quot;tit&quot;)', '<p>[a](url &quot;tit&quot;)</p>\n'),
    ('&#42;foo&#42;', '<p>*foo*</p>\n'),
    ('foo\\\nbar', '<p>foo<br />\nbar</p>\n'),
    ('foo  ', '<p>foo</p>\n'),
    ('<foo@bar.example.com> <m:abc> <not link>', '<p><a href="mailto:foo@bar.example.com">foo@bar.example.com</a> &lt;m:abc&gt; &lt;not link&gt;</p>\n'),
    ('<b>x</b>', '<p>&lt;b&gt;x&lt;/b&gt;</p>\n'),
    ('[x](javascript:alert(1))', '<p>[x](javascript:alert(1))</p>\n'),
    ('~~~~    ruby startline=3 $%@#$\ndef\n~~~~~~~', '<pre><code class="language-ruby">def\n</code></pre>\n'),
    ('  ```\naaa\n  aaa\n ```', '<pre><code>aaa\naaa\n</code></pre>\n'),
    ('> ```\n> aaa\n\nbbb', '<blockquote>\n<pre><code>aaa\n</code></pre>\n</blockquote>\n<p>bbb</p>\n'),
    ('```\n\n  \n```', '<pre><code>\n  \n</code></pre>\n'),
    ('```', '<pre><code></code></pre>\n'),
    ('    chunk1\n\n    chunk2\n  \n \n \n    chunk3', '<pre><code>chunk1\n\nchunk2\n\n\n\nchunk3\n</code></pre>\n'),
    ('1.  A\n    b\n\n        code\n\n    > q', '<ol>\n<li>\n<p>A\nb</p>\n<pre><code>code\n</code></pre>\n<blockquote>\n<p>q</p>\n</blockquote>\n</li>\n</ol>\n'),
    ('- one\n\n two', '<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n'),
    ('-one\n\n2.two', '<p>-one</p>\n<p>2.two</p>\n'),
    ('123456789. ok', '<ol start="123456789">\n<li>ok</li>\n</ol>\n'),
    ('- a\n - b\n  - c\n   - d\n    - e', '<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d\n- e</li>\n</ul>\n'),
    ('- foo\n\n\n- baz\n\n\n  bim', '<ul>\n<li>\n<p>foo</p>\n</li>\n<li>\n<p>baz</p>\n<p>bim</p>\n</li>\n</ul>\n'),
    ('* a\n*\n\n* c', '<ul>\n<li>\n<p>a</p>\n</li>\n<li></li>\n<li>\n<p>c</p>\n</li>\n</ul>\n'),
    ('- - foo', '<ul>\n<li>\n<ul>\n<li>foo</li>\n</ul>\n</li>\n</ul>\n'),
    ('1. a\n2) b', '<ol>\n<li>a</li>\n</ol>\n<ol start="2">\n<li>b</li>\n</ol>\n'),
    ('>bar\nbaz\n> foo', '<blockquote>\n<p>bar\nbaz\nfoo</p>\n</blockquote>\n'),
    ('>\n> foo\n>  ', '<blockquote>\n<p>foo</p>\n</blockquote>\n'),
    ('> foo\n\n> bar', '<blockquote>\n<p>foo</p>\n</blockquote>\n<blockquote>\n<p>bar</p>\n</blockquote>\n'),
    ('> bar\n>\nbaz', '<blockquote>\n<p>bar</p>\n</blockquote>\n<p>baz</p>\n'),
    ('aaa\n             bbb\n   ccc', '<p>aaa\nbbb\nccc</p>\n'),
]


@pytest.mark.parametrize(("text", "want"), EXAMPLES)
def test_examples(text, want):
    assert commonmark.render(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("|a|b|\n|:-|-:|\n|1|*2*|\n|3|", '<table>\n<thead>\n<tr>\n<th style="text-align:left">a</th>\n<th style="text-align:right">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td style="text-align:left">1</td>\n<td style="text-align:right"><em>2</em></td>\n</tr>\n<tr>\n<td style="text-align:left">3</td>\n<td style="text-align:right"></td>\n</tr>\n</tbody>\n</table>\n'),
        ("x\na | b\n- | -\nc \\| d | e\n\nz", "<p>x</p>\n<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>c | d</td>\n<td>e</td>\n</tr>\n</tbody>\n</table>\n<p>z</p>\n"),
        ("a | b\n- | - | -", "<p>a | b</p>\n<ul>\n<li>| - | -</li>\n</ul>\n"),
    ],
)
def test_tables(text, want):
    assert commonmark.render(text, tables=True) == want
    assert "<table>" not in commonmark.render(text)


HOSTILE = {
    "emphasis": "*a **b ", "strong": "**a ", "brackets": "[", "links": "[a](b", "ticks": "`a``b", "marks": "_a __b", "backslashes": "\\\n", "titles": '[a](b "\\"', "entities": "&a", "pointed": "<a:", "items": "- a\n", "quotes": ">", "nested items": "* + ", "references": "[a]: b\n", "tables": "|a|b\n|-|-\n", "closers": "a* ", "underlines": "a\n=\n",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_linear_time(name):
    unit = HOSTILE[name]

    def seconds(size: int) -> float:
        text = unit * (size // len(unit))
        began = time.process_time()
        commonmark.render(text, tables=True)
        return time.process_time() - began

    few, many = seconds(40_000), seconds(320_000)
    assert many < 20 * few + 2  # eight times the text


def test_a_long_text():
    began = time.process_time()
    text = "*a **b " * (2_000_000 // 7)
    assert len(commonmark.render(text)) == len(text) - 1 + len("<p></p>\n")
    assert time.process_time() - began < 60


def test_deep_nesting():
    n = 20_000
    assert commonmark.render(">" * n + " a").count("<blockquote>") == n
    assert commonmark.render("* " * n + "a").count("<ul>") == n
    assert commonmark.render("*" * 2 * n + "a" + "*" * 2 * n).count("<strong>") == n
    assert commonmark.render("[" * n + "a" + "](u)" * n).count("<a ") == 1


def test_tags_are_well_nested():
    rnd = random.Random(6)
    for _ in range(3000):
        text = "".join(rnd.choice(["*", "**", "_", "__", "a", " ", "b", "[", "]", "(u)", "`", "!", "\n", "- ", "> ", "<", "&", "\\", "#", "    "]) for _ in range(rnd.randrange(1, 40)))
        out, held = commonmark.render(text, tables=True), []
        for m in re.finditer(r"<(/?)([a-z0-9]+)[^>]*?(/?)>", out):
            if m[1]:
                assert held.pop() == m[2], (text, out)
            elif not m[3]:
                held.append(m[2])
        assert not held
        plain = html.unescape(re.sub(r"<[^>]+>", "", out))
        assert sorted(re.sub(r"[^ab]", "", plain)) == sorted(re.sub(r"[^ab]", "", text)) or "](u)" in text or "`" in text


def test_plain_text():
    assert markup.plain_of("***a*** ![i](u) and\\\nb &lt;") == "a and b <"


def test_forms_leave_in_slices(spark, monkeypatch):
    """Both forms of all rows, whatever the slices; a text longer than one is a slice by itself."""
    texts = ["*a* & b", None, "", "# " + "x " * 40, "[a](b)\n\n- c", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").coalesce(1)
    want = [(i, None if x is None else markup.render_markdown(x), None if x is None else markup.plain_of(x)) for i, x in enumerate(texts)]
    got = df.select("i", markup.markdown_forms("x").alias("f")).select("i", "f.html", "f.plain")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in df.select("i", markup.markdown_html("x"), markup.markdown_plain("x")).collect()) == want
    assert df.filter("i > 9").select(markup.markdown_forms("x")).collect() == []
    monkeypatch.setattr(markup, "SLICE", 10)
    assert [len(x) for x in markup._slices(pa.array(texts))] == [3, 1, 1, 1] and list(markup._slices(pa.array([], pa.string()))) == [[]]
    assert markup._made(pa.array(texts), str.upper, "string").to_pylist() == [None if x is None else x.upper() for x in texts]


def test_a_batch_is_not_python_objects_as_a_whole():
    """What a worker holds follows the slice, not the batch (20 MB of texts, 20 MB of results)."""
    texts = pa.array([f"{i} " + "x" * 10_000 for i in range(2000)])
    tracemalloc.start()
    try:
        made = markup._made(texts, str.upper, "string")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made) == 2000 and made[7].as_py() == texts[7].as_py().upper() and peak < 4 * markup.SLICE
