"""Inner products, urls, personal data, licences and languages against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from risemeter.llm import inner, language, licenses, personal, urls


def top(rows, k=5):
    held = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in held if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in held if j != i)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_inner_products(spark):
    dice = np.random.default_rng(2)
    rows = [(i, (dice.normal(size=8) * dice.lognormal(0, 1.5)).tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [1.0] * 8), (2200, []), (2250, [0.5, -3.0]), (2300, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as norm", "2 as rank", "3 as v")
    for sizes in ({}, {"query_block": 5, "shard_rows": 90}):
        found = inner.top_inner_products(df, F.col("vec_id") % 50 == 0, **sizes).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == top(rows)
    assert inner.top_inner_products(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert inner.top_inner_products(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0).collect() == []


def test_large_components_take_part(spark):
    big = 2.0**21
    rows = [(0, [1.0, 1.0]), (1, [big, 1.0]), (2, [1.0, 2.0]), (50, [2.0**22, -(2.0**20)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = inner.top_inner_products(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == top(rows)
    wide = spark.createDataFrame([(0, [2.0**20] * 100), (1, [2.0**20] * 100)], "vec_id long, embedding array<float>")
    assert [r.score for r in inner.top_inner_products(wide, F.col("vec_id") % 50 == 0).collect()] == [100 * 2**56]
    for far in ([2.0**30] * 300, [2.0**40], [2.0**60]):
        wide = spark.createDataFrame([(0, far), (1, far)], "vec_id long, embedding array<float>")
        try:
            inner.top_inner_products(wide, F.col("vec_id") % 50 == 0).collect()
        except Exception as error:  # noqa: BLE001 - the kind depends on where the number outgrows a long
            assert "exceeds a long" in str(error)
        else:
            raise AssertionError("a score beyond a long must not come back")


def test_pruning_drops_nothing_and_saves_work():
    dice = np.random.default_rng(5)
    shard = np.floor(dice.normal(size=(5000, 16)) * dice.lognormal(2, 1, size=(5000, 1)) * 20).astype(np.int64)
    queries = shard[:7]
    _, turn = np.linalg.eigh((shard.T @ shard).astype(float))
    ids, names, scores = inner.block_top(np.arange(7), queries, np.full(7, inner.LOWEST), np.arange(5000), shard, turn[:, ::-1], 5, leading=6)
    for q in range(7):
        products = shard @ queries[q]
        order = sorted((-int(s), k) for k, s in enumerate(products) if k != q)[:5]
        assert sorted((-int(s), int(k)) for i, k, s in zip(ids, names, scores, strict=True) if i == q)[:5] == order


URLS = [None, "nourl", "", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://net/", "x://.org/fr/://b", "://", "http://xexample.net/en/", "http://example.com?/de/",
        "http://example.com/de/", "http://a.org/FR/", "http://a.org/fr", "a\nb://Ü.NET/é?", "https://www.free-bets.example.com/a", "http://betsy.org/", "http://x.com/" + "a/" * 50_000, "http://" + "a." * 20_000 + "net/"]


def judged(url, rules=urls.RULES, words=urls.LISTED_WORDS):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if set(re.split("[^a-z0-9]+", host)) & set(words) else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[3]), (3, URLS[3])], "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as key")
    found = urls.url_verdicts(pages).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(URLS[3 if r.page_id is None else r.page_id]), r.page_id
    assert urls.url_verdicts(pages.where("false")).collect() == []
    assert {r.verdict for r in urls.url_verdicts(pages, rules=(), listed_words=()).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    listed = spark.range(0, 300).selectExpr("cast(id * 7 as string) as key")
    universe = spark.range(0, 6000).selectExpr("cast(id as string) as key")
    levels = urls.build_cascade(listed, universe)
    assert len(levels) > 1 and sum(len(level.bits) for level in levels) < 1500
    found = universe.select("key", urls.listed_in(levels, F.col("key")).alias("is_listed")).collect()
    assert all(r.is_listed == (int(r.key) % 7 == 0 and int(r.key) < 2100) for r in found)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    turned = [int(c) for c in digits][::-1]
    return (sum(turned[::2]) + sum(sum(divmod(2 * x, 10)) for x in turned[1::2])) % 10 == 0


def base(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            found += [f"{kind}:{m.start()}:{m.end()}"] * good
    return ",".join(found)


PERSONAL = ["a@b.c_d@e.f x@y..z.w q@w-e.com. a@@b.c é@b.co", "1.2.3.4.5 999.1.1.1 0001.2.3.4 1.2.3.4.5.6.7.8", "x4111 1111 1111 1111 4111-1111-1111-1112 card 4111111111111112", "+1 (2) 3-4.5 678901 +1 (269) 555-3296 4524",
            "mail bob (at) example.com tel (212) 555-1234 ", None, "", "𝒳 éé a@b.co 𝒳 1.2.3.4", "a" * 30_000 + "@x.y " + "1" * 30_000 + "+" * 3000, "a@b.c" + ".d" * 5000 + " 12-" * 3, "1 2 " * 300 + "4111111111111111"]


def test_personal_data(spark):
    dice = random.Random(1)
    texts = PERSONAL + ["".join(dice.choices("a.@+1 2-(4)", k=80)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])], "doc_id long, text string").selectExpr("*", "1 as base", "2 as spans")
    found = personal.personal_spans(docs).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        text = texts[r.doc_id or 0] or ""
        wanted = base(text) if len(text) < 20_000 else "email:0:30004"
        assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest(), (r.doc_id, text[:200], wanted, r.spans[:300])
        assert set(filter(None, wanted.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(wanted.count(k) for k in PLAIN)
    assert "phone" in next(r.spans for r in found if r.doc_id == 4)
    assert personal.personal_spans(docs.where("false")).collect() == []


def test_reliabilities_follow_agreement():
    belief = personal.reliabilities([(0, (1, 1, 1), 80), (0, (1, 1, 0), 200), (0, (-1, -1, 0), 150), (0, (-1, 1, 0), 5), (0, (0, 1, 1), 10)])
    assert belief[0, (1, 1, 1)] > 0.95 > 0.5 > belief[0, (-1, -1, 0)] and belief[0, (0, 1, 1)] > belief[0, (-1, 1, 0)]


def test_licences(spark):
    files = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/src/a.py", "print(1)"), (3, "r/src/deep/b.py", None), (4, "r/third/COPYING", "GNU General Public License, version 3"),
        (5, "r/third/x/y.c", "int x;"), (6, "r/third/own.c", "// Licensed under the Apache License, Version 2.0."), (7, "q/z.py", "nothing"), (8, None, None), (None, "r/src/a.py", "x"), (2, "r/src/a.py", "print(1)"),
        (9, "r/page.html", "<p>Licensed under <b>CC BY-NC 4.0</b></p>"), (10, "r/" + "d/" * 20_000 + "f", "x " * 100_000), (11, "rr/a", ""),
    ]
    df = spark.createDataFrame(files, "id long, path string, text string").selectExpr("*", "1 as row", "2 as license")
    found = licenses.scan_licenses(df).collect()
    got = sorted(((r.id, r.license, r.source) for r in found), key=repr)
    wanted = [(1, "MIT", "own"), (2, "MIT", "inherited"), (2, "MIT", "inherited"), (3, "MIT", "inherited"), (4, "GPL-3.0", "own"), (5, "GPL-3.0", "inherited"), (6, "Apache-2.0", "own"), (7, None, None), (8, None, None),
              (None, "MIT", "inherited"), (9, "MIT", "inherited"), (10, "MIT", "inherited"), (11, None, None)]
    assert got == sorted(wanted, key=repr)
    assert licenses.scan_licenses(df.where("false")).collect() == []


def viterbi(scores, switch):
    best = scores[0].copy()
    for row in scores[1:]:
        best = np.maximum(best, best.max() - switch) + row
    return best.max()


def test_best_path_is_optimal():
    dice = np.random.default_rng(0)
    for _ in range(1500):
        n = int(dice.integers(1, 40))
        scores = -dice.random((n, 3)) * float(dice.choice([1, 4, 8]))
        scores[np.arange(n), dice.integers(0, 3, n)] = 0
        if dice.random() < 0.6:
            scores[: n // 2, 0] = 0
        path = language.best_path(scores)
        assert abs(scores[np.arange(n), path].sum() - language.SWITCH * (np.diff(path) != 0).sum() - viterbi(scores, language.SWITCH)) < 1e-9


def test_languages(spark):
    dice = random.Random(3)
    words = {"aa": ["the", "with", "thing", "other"], "bb": ["und", "nicht", "schön", "auch"], "ru": ["это", "что", "как", "она"]}
    make = lambda lang, n: " ".join(dice.choices(words[lang], k=n))
    rows = [(i, make(lang, dice.randint(3, 50)), lang) for i in range(300) for lang in [dice.choice(list(words))]]
    odd = [(900, None, "aa"), (901, "12 ... !", "bb"), (902, "", None), (None, make("bb", 20), None), (903, make("aa", 40) + " " + make("bb", 30), None), (904, make("aa", 60_000), "aa"), (905, "かな 漢字", None), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as spans")
    found = language.languages(docs).collect()
    assert len(found) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and all(r.lang_pred == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[None].lang_pred == "bb" and by[905].lang_pred in words
    assert [s.lang for s in by[903].spans] == ["aa", "bb"] and by[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(docs.where("false")).collect() == []


def test_labels_of_other_rows_are_no_inputs(spark):
    docs = spark.createDataFrame([(i, "the thing", "aa") for i in range(40)] + [(i, "und nicht", "bb") for i in range(40, 80)], "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    one, two = ({(r.doc_id, r.lang_pred, r.score) for r in language.languages(d).collect()} for d in (docs, other))
    assert one == two


def test_script_ranges_are_in_order():
    assert [a for a, _ in language.RANGES] == sorted({a for a, _ in language.RANGES})
    assert list(language.label(language.Model((), np.zeros((language.BUCKETS, 0)), np.zeros((len(language.SCRIPTS), 0), bool)), pa.array(["abc"]))) == [("und", 0.0, [])]


def test_licences_within_longer_lines(spark):
    rest = "home about contact imprint careers press newsletter support status pricing blog docs forum community events partners"
    files = [
        (1, "a/index.htm", f"{rest} Released under the MIT License {rest}"),
        (2, "a/x.min.js", f"/*! {rest.replace(' ', ';')} Licensed under the Apache License, Version 2.0 */" + "var a=1;" * 5000),
        (3, "a/y.c", "if (a < b) run();\n// GNU General Public License, version 3\nif (c > d) stop();"),
        (4, "a/z.txt", f"{rest} ask for a licence or a license before you print {rest}"),
        (5, "a/p.html", f"<div>{rest}</div><p>GNU Lesser General Public License, version 3</p>"),
        (6, "a/q.txt", f"{rest} this work is licensed under the GNU Lesser General Public License, version 3 {rest} " * 20),
    ]
    found = licenses.scan_licenses(spark.createDataFrame(files, "id long, path string, text string")).collect()
    assert {r.id: r.license for r in found} == {1: "MIT", 2: "Apache-2.0", 3: "GPL-3.0", 4: None, 5: "LGPL-3.0", 6: "LGPL-3.0"}


def test_marks_alone_are_no_letters():
    codes = np.array([ord(c) for c in "a\u0301\u093e1\u0915"], dtype=np.uint32)
    assert language.is_letter(codes).tolist() == [True, False, False, False, True]
