import zlib

import corpus_pipeline
import public_tokenizers
from llm_cases import frame, prose
from test_documents import brute_base, brute_components, brute_lines, brute_mix
from tokenizers import Tokenizer

from keyloom.llm import page_wrappers as pw, toxicity


def page(i, paragraphs, comments=True):
    body = "".join(f"<p>{x}" for x in paragraphs)
    return (f"<!DOCTYPE html><html><head><title>T {i}</title><script>var a='</p><article>no';</script><style>p{{}}</style></head><body>"
            f"<header><a href=/>Site</a></header><nav><ul><li>Home<li>News {i}</ul></nav><div class='cookie-notice'>We use cookies</div>"
            f"<div class='story'><h1>Head&amp;line {i}</h1>{body}<form><input>Sign up</form><div class=\"ad box\">Buy {i}</div></div>"
            + (f"<section id='comments'><p>Nice {i}</p></section>" if comments else "") + f"<aside>More {i}</aside><footer>&copy; {i}</footer></body>")


def test_wrappers_find_the_article_without_its_tag(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", page(i, [f"First  {i}\n<b>bold</b> text.", *["More<br>words &lt; here."] * (i % 4)], i % 3 > 0))
            for i in range(20)]
    rows += [(90, None, None), (91, "https://h0.example/x", ""), (92, "http://[bad", "plain text"), (None, "https://h1.example/y", page(7, ["P"])),
             (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")
    got = {(r.page_id, r.url): r for r in pw.main_texts(df).collect()}
    for i in range(20):
        want = "\n".join([f"Head&line {i}", f"First {i} bold text.", *["More words < here."] * (i % 4)])
        assert got[i, rows[i][1]].text == want and got[i, rows[i][1]].n_chars == len(want)
    assert got[90, None].text == "" and got[91, "https://h0.example/x"].text == "" and got[92, "http://[bad"].text == "plain text"
    assert got[None, "https://h1.example/y"].text == "Head&line 7\nP"
    assert pw.main_texts(df).count() == len(rows) and pw.main_texts(df.limit(0)).count() == 0


def test_wrapper_groups():
    one = pw.expression(pw.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl><p>x"))
    two = pw.expression(pw.parse("<dl><dt>a<dd>e</dl><h2>t</h2><p>x<p>y"))
    both = pw.align(one, two)
    assert [(c[0], c[1]) for c in both[4]] == [("dl", ""), ("h2", "?"), ("p", "+")]
    assert both[4][0][4][0][0].startswith("()") and both[4][0][4][0][1] in ("+", "*")


def test_article_tag_and_header_inside():
    html = ("<body><header>Top</header><article><header><h1>Own</h1></header><p>Text&nbsp;one<ul><li>a<li>b</ul><div class=related>x</div>"
            "<figure><figcaption>cap</figcaption></figure></article>")
    assert pw.main_text(html, None) == "Own\nText one\na\nb\ncap"
    assert pw.main_text('<div class="site-header">Top</div><main><div class="post-header"><h1>A</h1></div><p>B</main>', None) == "A\nB"


def test_toxicity_on_held_out_rows(spark):
    bad = ["grubnak", "zorptwit", "flonkhead", "mudgelump"]
    texts, labels = [], []
    for i in range(900):
        words = prose(i, 40 + i % 20).split()
        toxic = i % 6 == 0
        if toxic:
            for k in range(2):
                words.insert(7 * k + i % 11, bad[(i // 6 + k) % 4] + ("" if i % 4 else "ing"))
        texts.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    texts += [(2000, None, "s"), (2001, "", None), (None, "plain words", "s"), (3, texts[3][1], "s")]
    labels += [(5, None), (None, 1), (6, 0)]
    lab = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, toxic int, score int")
    rows = toxicity.score(frame(spark, texts), lab).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r for r in rows if r.held_out and r.doc_id < 900]
    assert all(r.predicted == int(r.doc_id % 6 == 0) for r in out)
    # Labels of held-out rows are never read.
    flipped = lab.withColumn("toxic", (1 - lab.toxic)).where(toxicity.held_out(lab.doc_id)).unionByName(lab.where(~toxicity.held_out(lab.doc_id)))
    assert sorted(map(str, toxicity.score(frame(spark, texts), flipped).collect())) == sorted(map(str, rows))
    assert {r.score for r in toxicity.score(frame(spark, texts[:5]), lab.limit(0)).collect()} == {0.0}
    assert toxicity.score(frame(spark).limit(0), lab).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    texts = [(i, prose(i, 60 + i % 30), "abc"[i % 3]) for i in range(60)]
    texts += [(100 + i, prose(300, 100) + f" end{i}", "a") for i in range(5)]
    texts += [(200 + i, f"{prose(400 + i, 60)}\nThis very line is found in many places.\n{prose(500 + i, 9)}", "b") for i in range(6)]
    texts += [(300, "a b c " * 30, "c"), (301, None, "c"), (302, "", None), (303, " | ".join(prose(9, 150).split()), "a")]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")

    now = [t for t in texts if not (lambda b: b[0] < 50 or 100 * b[4] > 50 * b[0])(brute_base(t[1] or "")) and t[0] != 303]
    now = [(i, line[3], s) for (i, _, s), line in zip(now, brute_lines(now))]
    _, component = brute_components(now)
    now = [t for t in now if component[t[0]] == t[0]]
    size, total, target = brute_mix(now)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n_tokens = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t, _ in now}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= set(n_tokens) and all(r.n_tokens == n_tokens[r.doc_id] for r in rows)
    taken = dict.fromkeys(total, 0)
    where = {i: (size(t), s) for i, t, s in now}
    for r in rows:
        taken[where[r.doc_id][1]] += where[r.doc_id][0]
    assert all(abs(taken[s] - target[s]) <= max(n for n, own in where.values() if own == s) / 2 + 1 for s in total)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    frame(spark).limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
