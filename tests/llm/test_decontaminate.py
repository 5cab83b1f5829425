import hashlib
import re

from quarry.llm.decontaminate import scan_documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = [(str(i), w[k : k + min(10, len(w))]) for i, t in items for w in [words(t)] if w and i is not None for k in range(len(w) - min(10, len(w)) + 1)]
    begins = {}
    for item, win in windows:
        begins.setdefault(win[0], []).append((item, win))
    out = []
    for doc, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for k, w in enumerate(ws):
            for item, win in begins.get(w, ()):
                if ws[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
        out.append((doc, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(docs, items, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in scan_documents(docs, items, **kw).collect()), key=str)


ITEMS = [(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "short item"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (3, None), (4, "- !"), (None, "x y"), (12, "Short; ITEM")]
DOCS = [
    (1, "Intro. W0 w1 w2, w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 end"),
    (2, "a short-item here, and a SHORT item there"),
    (3, "w0 w1 w2 w3 w4 w5 w6 w7 w8"),
    (4, None),
    (5, ""),
    (6, "short short item"),
]


def test_small_and_in_blocks(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS)
    assert run(docs, items) == want
    assert run(docs, items, most_chars=5) == want  # several blocks, marks joined
    assert run(docs, items, texts=False) == want
    clean = {r.doc_id: r.clean_text for r in scan_documents(docs, items).collect()}
    assert clean[1] == "Intro.  end" and clean[2] == "a  here, and a  there" and clean[4] is None and clean[3] == DOCS[2][1]


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(odd, items) == brute(rows, ITEMS)
    assert run(odd, none) == brute(rows, []) and run(empty, items) == []


def test_whole_table(spark, documents, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = run(documents, items)
    rows = documents.collect()
    assert got == brute([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in items.collect()])
    assert any(n for _, _, n, _ in got)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
