from staffline.llm import urltree
from tests.llm.conftest import SF, pairs


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:ends[0]])
    rest = rest[ends[0]:]
    ends = [i for i, c in enumerate(rest) if c in "?#"] + [len(rest)]
    return host, rest[:ends[0]]


def rule_of(host, path):
    best = None
    for verdict, rule in urltree.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def check(pages):
    got = urltree.judge_urls(pages)
    want = []
    for r in pages.select("page_id", "url").collect():
        h, p = parts(r["url"])
        want.append((r["page_id"], h, p, (rule_of(h, p) or (None,))[0]))
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert pairs(got, "page_id", "host", "path", "rule") == sorted(want, key=key)
    for r in got.collect():
        given = rule_of(r["host"], r["path"])
        assert r["verdict"] == given[1] if given else r["verdict"] in ("allow", "block")
    return got


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net", "http://a.net/", "http://anet/x", "http://x.example.net/en/1",
            "http://example.net/en", "http://example.net/en/1?q=http://b.org/fr/", "a://b://c.net/d", "http://É.ORG/fr/",
            "http://h.org/fr/" + "9" * 50000, "http://a.example.com/de/1/2/3/4/5/6", "http://a.net/\nx#y", "http://a.net/"]
    rows = [(i, u, "h", "zz") for i, u in enumerate(urls)] + [(None, "http://a.net/", None, None)]
    check(spark.createDataFrame(rows, "page_id long, url string, host string, template string"))


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF}/pages.parquet"))


def test_empty_table(spark):
    assert urltree.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows = [("http://a.com/spam/%d.html" % i,) for i in range(30)]      # ruled: block
    rows += [("http://a.com/spam/x%s" % chr(97 + i),) for i in range(20)]  # like them, by no rule
    rows += [("http://a.com/good/%d" % i,) for i in range(30)]           # ruled: allow
    rows += [("http://a.com/other/page",)] * 5                           # no evidence
    rules = (("block", "a.com/spam/"), ("allow", "a.com/good/"))
    pages = spark.createDataFrame([(i, u) for i, (u,) in enumerate(rows)], "page_id long, url string")
    half = (("block", "a.com/spam/1"), ("block", "a.com/spam/2"), ("allow", "a.com/good/"))
    got = {r["path"]: r for r in urltree.judge_urls(pages, rules=half, max_kinds=5).collect()}
    assert got["/spam/3.html"]["rule"] is None and got["/spam/3.html"]["verdict"] == "block"
    assert got["/other/page"]["verdict"] == "allow" and got["/good/1"]["verdict"] == "allow"
    assert got["/spam/3.html"]["template"] == "/spam/#.html"
    got = {r["path"]: r for r in urltree.judge_urls(pages, rules=rules, max_kinds=5).collect()}
    assert got["/spam/xa"]["template"] == "/spam/*"


def test_paths_that_differ_only_at_the_sixth_segment(spark):
    deep = "/a/b/c/d/e"
    urls = [f"http://a.com{deep}/{kind}/{i}.html" for kind in ("spam", "good") for i in range(30)] + ["http://b.com" + "/x" * 300]
    rules = (("block", f"a.com{deep}/spam/1"), ("block", f"a.com{deep}/spam/2"), ("allow", f"a.com{deep}/good/1"),
             ("allow", f"a.com{deep}/good/2"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["path"]: r for r in urltree.judge_urls(pages, rules=rules).collect()}
    assert len(got) == len(urls)
    spam, good = got[f"{deep}/spam/3.html"], got[f"{deep}/good/3.html"]
    assert spam["rule"] is None and good["rule"] is None
    assert (spam["template"], good["template"]) == (f"{deep}/spam/#.html", f"{deep}/good/#.html")
    assert (spam["verdict"], good["verdict"]) == ("block", "allow")
    assert got["/x" * 300]["template"] == "/x" * 300


def test_nothing_is_rejected_without_labels_of_its_own(spark):
    urls = [f"http://a.example.com/de/{k}" for k in range(40)] + [f"http://a.example.com/en/{k}" for k in range(200)]
    urls += [f"http://a.example.com/{k}" for k in ("x", "y/z", "")] + [f"http://b.example.com/fr/{k}" for k in range(9)]
    got = urltree.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert all((r["verdict"] == "block") == ("/de/" in r["path"]) for r in got)


def test_whole_table_rejects_only_labelled_templates(spark):
    got = urltree.judge_urls(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    labelled = {(r["host"], r["template"]) for r in got if r["rule"]}
    assert all(r["verdict"] == "allow" or (r["host"], r["template"]) in labelled for r in got)


def test_native_plan(spark):
    plan = urltree.judge_urls(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
