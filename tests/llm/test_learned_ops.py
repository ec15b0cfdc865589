"""Quality classifier, decision lists, HTML extraction: held-out accuracy and parts against plain computations."""
import collections
import html
import re

import numpy as np
import pytest

from llm_helpers import SF
from subseg.llm import block_labeller as L
from subseg.llm import decision_list as D
from subseg.llm import fourier_quality as Q
from subseg.llm import queries
from subseg.llm.html_blocks import leaf_blocks

def truth(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")


def test_classifier_on_held_out_labels(spark):
    got = queries.op5_quality_classifier(spark, SF).toPandas().set_index("doc_id").join(truth(spark, SF), how="inner")
    held = got[got.held_out]
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.7)).all()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    assert auc > 0.95 and (held.predicted == held.quality).mean() > 0.93


def test_normal_equations(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, label double").repartition(7)
    omega, phase = rng.normal(size=(3, 40)), rng.uniform(0, 6, 40)
    zz, zy = Q.normal_equations(rows, ["a", "b", "c"], np.zeros(3), np.ones(3), omega, phase)
    z = Q.lift(x, omega, phase)
    np.testing.assert_allclose(zz, z.T @ z)
    np.testing.assert_allclose(zy, z.T @ y)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    gamma = 0.3
    z = Q.lift(x, rng.normal(0, np.sqrt(2 * gamma), (4, 20_000)), rng.uniform(0, 2 * np.pi, 20_000))[:, :-1]
    want = np.exp(-gamma * ((x[:, None] - x) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.06


def test_pool_adjacent():
    v, w = np.array([1.0, 3.0, 2.0, 2.0, 5.0, 4.0]), np.array([1.0, 1.0, 1.0, 2.0, 1.0, 3.0])
    got = Q.pool_adjacent(v, w)
    np.testing.assert_allclose(got, [1, 2.25, 2.25, 2.25, 4.25, 4.25])


def test_rules_find_a_planted_list(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(3000, 4))
    reject = ((x[:, 0] >= 0.8) & (x[:, 1] <= 0.3)) | (x[:, 2] >= 0.95)
    names = ("a", "b", "c", "d")
    rules = D.learn(x, reject, names)
    covered = np.zeros(len(x), bool)
    for r in rules:
        covered |= D._covers(r, x, names)
    assert (covered == reject).mean() > 0.985
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = [r[0] is not None for r in df.select(D.as_column(rules).alias("r")).collect()]
    assert got == covered.tolist()


def test_precision_and_cover_alone_end_the_list():
    """More rules and longer rules than any small fixed number."""
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(40_000, 1))
    reject = (x[:, 0] * 48).astype(int) % 2 == 0
    rules = D.learn(x, reject, ("a",), n_cuts=2000)
    covered = np.any([D._covers(r, x, ("a",)) for r in rules], axis=0)
    assert len(rules) > 16 and (covered == reject).mean() > 0.95
    x = rng.uniform(size=(40_000, 6))
    reject = (x >= 0.35).all(axis=1)
    rules = D.learn(x, reject, tuple("abcdef"))
    assert max(map(len, rules)) > 4


def test_no_class_no_rule():
    x = np.random.default_rng(0).uniform(size=(50, 2))
    assert D.learn(x, np.zeros(50, bool), ("a", "b")) == [] and D.learn(x[:0], np.zeros(0, bool), ("a", "b")) == []


def test_rules_on_documents(spark):
    got = queries.op7_quality_rules(spark, SF).toPandas().set_index("doc_id").join(truth(spark, SF), how="inner")
    rest = got[~got.base_failed]
    assert (rest.kept == (rest.quality == 1)).mean() > 0.95
    assert not got[got.base_failed].kept.any()


def expected(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1].replace("<br>", " ")
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_article_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    got = queries.op3_html_text(spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    assert (got.text == pages.html.map(expected).reindex(got.index)).all()
    assert (got.n_chars == got.text.str.len()).all() and (got.url == pages.url.reindex(got.index)).all()


@pytest.fixture(scope="module")
def model(spark):
    return L.train_on(spark.read.parquet(f"{SF}/pages.parquet"))


def extract(model, page):
    leaves = leaf_blocks(page)
    return [x.text for x, y in zip(leaves, L.label_pages(model, [leaves])[0]) if y]


UNSEEN = [
    "<html><body><div class='navbar'><ul><li><a href=x>Home</a></li><li><a>News</a></li></ul></div><div class='content'><h1>T one</h1><p>Body a b c.</p><p>Body d e f.</p></div>"
    "<div class='sidebar'><p>Popular x</p></div><div id='comments'><p>I liked it</p></div><div class='footer'>(c) us</div></body></html>",
    "<html><body><header><div>Site name</div></header><main><article><h1>T one</h1><p>Body a b c.</p><p>Body d e f.</p></article></main>"
    "<aside><p>Related y</p></aside><form class=newsletter><p>Sign up</p></form><footer><p>Legal</p></footer></body></html>",
    "<html><body><nav><a>Menu</a></nav><div class='cookie-notice'><p>We use cookies</p></div><section class='story'><h1>T one</h1><p>Body a b c.</p><div class='advert'><p>Buy</p></div>"
    "<p>Body d e f.</p></section><section class='comments'><p>first!</p><p>second</p></section></body></html>",
]


@pytest.mark.parametrize("page", UNSEEN)
def test_other_layouts(model, page):
    assert extract(model, page) == ["T one", "Body a b c.", "Body d e f."]


def test_blocks_of_broken_html():
    blocks = lambda p: [x.text for x in leaf_blocks(p)]
    assert blocks("<p>a &amp; b&nbsp;c<br>d<p>e<script>var x='</p>'</script> f") == ["a & b c d", "e f"]
    assert blocks("<ul><li>one<li>two</ul>three") == ["one", "two", "three"]
    assert blocks("a < b and c > d <!-- no <p>x --> e") == ["a < b and c > d e"]
    assert blocks("<style>p{}</style><p title='a>b'>x</p><!-- open") == ["x"]
    assert blocks("") == [] and blocks("<p></p><div> \n </div>") == []
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]


def test_foreign_content_is_text():
    """svg, math, object and iframe lose no text, closed or not; scripts, styles and inert templates have none."""
    blocks = lambda p: [x.text for x in leaf_blocks(p)]
    assert blocks("<p>a</p><svg><text>label</text><p>rest</p>") == ["a", "label", "rest"]
    assert blocks("<p>a</p><object data=x><p>after</p><p>b</p>") == ["a", "after", "b"]
    assert blocks("<p>area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> of it") == ["area x=2 of it"]
    assert blocks("<iframe src=y>no frames here</iframe><p>b") == ["no frames here", "b"]
    assert blocks("<template><p>x</p></template><script>1</script><style>p</style><p>b") == ["b"]


def test_long_pages_train_whole():
    """Leaves far down a training page count, and batches of long pages stay bounded."""
    page = "<html><body><article>" + "<p>text of it</p>" * 300 + "</article><footer>" + "<p>legal end</p>" * 40 + "</footer></body></html>"
    model = L.train([page] * 6, copies=0, cells=700)
    (got,) = L.label_pages(model, [leaf_blocks(page)])
    assert got[:300].mean() > 0.95 and got[300:].mean() < 0.1


def test_odd_pages(spark):
    """Very long and repeated pages, nulls, clashing columns: a row each, with values."""
    long = "<html><body><nav><a>menu</a></nav><article>" + "".join(f"<p>part {i} of the text</p>" for i in range(3000)) + "</article></body></html>"
    short = "<html><body><nav><a>menu</a></nav><article><h1>T</h1><p>one &amp; two</p></article><footer><p>legal</p></footer></body></html>"
    rows = [(i, "u", h) for i, h in enumerate([short] * 20 + [None, "", long, short])] + [(3, "u", short), (None, "u", short)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' as text", "1 as label", "2 as id", "3 as __text", "4 as n_chars").repartition(3)
    model = L.train_on(spark.read.parquet(f"{SF}/pages.parquet"))
    got = L.extract_text(pages, model=model).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r.text)
    assert by[20] == by[21] == [""] and by[3] == ["T\n\none & two"] * 2 and by[23] == by[None] == ["T\n\none & two"]
    assert by[22] == ["\n\n".join(f"part {i} of the text" for i in range(3000))]


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    m = L.BiLstm.fresh(1)
    x = rng.normal(size=(4, 3, L.INPUT))
    mask = np.ones((4, 3), bool)
    mask[2:, 1] = False
    y = rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        p = m.probability(x, mask)
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    grad = m.gradient(x, mask, y)
    for k in m.p:
        i = tuple(int(rng.integers(s)) for s in m.p[k].shape)
        keep, eps = m.p[k][i], 1e-5
        m.p[k][i] = keep + eps
        up = loss()
        m.p[k][i] = keep - eps
        down = loss()
        m.p[k][i] = keep
        assert abs((up - down) / (2 * eps) - grad[k][i]) < 1e-6, k


def test_no_pages_and_empty_html(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 4), (None, "v", "<article><p>x</p></article>", 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in L.extract_text(pages).collect()}
    assert got == {1: "", 2: "", None: "x"}
    assert L.extract_text(pages.limit(0)).count() == 0
