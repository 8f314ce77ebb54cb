import random

import numpy as np
import pytest

from cairn.llm import contamination, mixture, sentences
from cairn.llm.boundaries import sentences as split
from cairn.llm.cgk import Embedding, leaks, normal_words
from cairn.sources.tables import table

CASES = [
    "It took 15.8 s on a node (approx. 28 rows). |See Fig. 29, or ask Dr. Kalansen from the team.| Why would anyone call `a.B()` twice?!",
    "Dr. Meier hat am 3. Mai gefragt, z. B. wegen Nr. 5.| „Bitte nicht anfassen! Er ist heikel.“ stand im Index.",
    "El Sr. López llegó.| ¡No edites a mano!| ¿Por qué?",
    "Il faut env. 41 lignes, p. ex. celles du filtre.| « Ne touchez pas ! Il est fragile. » disait la note de M. Devan.",
    "值班的人说:“别动索引!它很脆弱。”然后关闭了。|为什么重启之后还占用日志?|Finox会等待59.0毫秒。",
    "再起動の後も保持するのはなぜですか?|「触らないで。壊れやすいから!」と書いてありました。",
    "ทำไมดัชนียังค้าง |ดัชนีถูกสร้างใหม่",
    "Γιατί κρατά το αρχείο;| Ο κ. Ρ μετέφερε, π.χ. στο a_b.rs!",
    "रुकता है। |डॉ. राम ने रखा।",
    "직접 고치지 마라! |node_batch.ts 파일을 고치지 마라!| 3.2 버전부터 만들어진다.",
    "The quota failed again...and nobody noticed.| Don't edit x.py by hand!| By 4 p.m. the branch had drained, etc., but it ran.",
    "لماذا يحتفظ بالقفل؟| قال د. سامي إنه انتهى.",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    text, want, at = case.replace("|", ""), [], 0
    for part in case.split("|"):
        want.append((at + len(part) - len(part.lstrip()), at + len(part.rstrip())))
        at += len(part)
    assert [text[a:b] for a, b in split(text)] == [text[a:b] for a, b in want]


def test_blocks():
    text = "# Head one. Two?\n\n> Quoted a.\n> Still b.\n\n- item one. More.\n* two\n1. three\n\n```\ncode. Here.\n```\nline one\nline two. End\n\n---\n"
    assert [text[a:b] for a, b in split(text)] == ["Head one. Two?", "Quoted a.", "Still b.", "item one. More.", "two", "three", "line one\nline two.", "End"]
    nested = "1. one\n   - sub a. B.\n     - deep\n   - sub\n2. two\n\n- am\n  3. Mai kam er\n\n3. three\n4. four\n\n?!\n"
    assert [text_of for text_of in (nested[a:b] for a, b in split(nested))] == ["one", "sub a. B.", "deep", "sub", "two", "am\n  3. Mai kam er", "three", "four", "?!"]
    long = "x" * 60 + "dr. So it ended. The dir/dr. Meier kept, " + "y" * 100 + " e.g. here."
    assert [long[a:b] for a, b in split(long)] == ["x" * 60 + "dr.", "So it ended.", "The dir/dr. Meier kept, " + "y" * 100 + " e.g. here."]
    assert split("") == [] and split(" \n\n ") == [] and split("```\nopen. Fence.") == []


def test_sentences_of_documents(spark):
    docs = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "x"), (3, "  ", "x"), (None, "A.", "x"), (4, "word " * 40_000, "x")], "doc_id long, text string, start_char string")
    assert sorted(tuple(r) for r in sentences.document_sentences(docs).collect()) == [(1, 0, 4), (1, 5, 9), (4, 0, 199_999)]
    assert {r.doc_id: r.sentences for r in sentences.sentence_counts(docs).collect()} == {1: 2, 2: 0, 3: 0, 4: 1}
    assert sentences.document_sentences(docs.limit(0)).count() == 0


def test_words():
    assert normal_words("The **stale**\\_Key\\n&#100;igest\u00ad x&amp;y\n> a") == ["the", "stale", "key", "digest", "x", "y", "a"]


def brute(doc, item):
    """Whether some 20 or more words of the item are in the document with one change in eight."""
    for start in range(len(item) - 19):
        cost = [0] * (len(doc) + 1)
        for i, w in enumerate(item[start:]):
            step = [i + 1]
            for j, d in enumerate(doc):
                step.append(min(cost[j] + (w != d), cost[j + 1] + 1, step[j] + 1))
            cost = step
            if i >= 19 and 8 * min(cost) <= i + 1:
                return True
    return False


def edited(run, kind, places, new):
    run = list(run)
    for k in sorted(places, reverse=True):
        how = kind if kind != "mixed" else ("replace", "insert", "delete")[k % 3]
        run[k : k + (how != "insert")] = [] if how == "delete" else [next(new)]
    return run


def test_exact_check_against_brute_force():
    rng, new, met = random.Random(5), iter(range(1000, 1_000_000)), [0, 0]
    for trial in range(120):
        size = rng.choice((20, 24, 32, 45))
        item = [rng.randrange(40) for _ in range(size + 20)]
        a = rng.randrange(10)
        part = edited(item[a : a + size], "mixed", rng.sample(range(size), rng.randrange(size // 8 + 3)), new)
        doc = [next(new) for _ in range(12)] + part + [next(new) for _ in range(12)]
        want = brute(doc, item)
        met[want] += 1
        assert leaks(np.array(doc), np.array(item), 12 - a - 4, 12 - a + 4, 20, 4) == want, trial
    assert min(met) > 20


#: Kind of change, words of the run, and where its changes are (None: anywhere).
EDITS = [
    ("replace", 20, None), ("insert", 20, None), ("delete", 20, None), ("mixed", 20, None), ("replace", 20, (6, 13)), ("insert", 20, (7, 13)), ("delete", 20, (6, 13)), ("delete", 20, (9, 10)),
    ("replace", 24, None), ("delete", 24, None), ("mixed", 24, None), ("replace", 24, (5, 11, 17)), ("replace", 24, (10, 11, 12)), ("replace", 32, None), ("mixed", 32, None), ("replace", 32, (14, 15, 16, 17)), ("replace", 32, (6, 12, 18, 25)),
]


def test_recall_end_to_end(spark):
    """Of 400 planted runs of each sort, with words nobody shares around them, 95 in 100 are found; and nothing else."""
    rng, new, trials = random.Random(3), (f"w{i}" for i in range(10_000_000)), 400
    docs, items, kinds = [], [], []
    for kind, size, places in EDITS:
        for _ in range(trials):
            words = [next(new) for _ in range(size + 30)]
            part = edited(words[15 : 15 + size], kind, places or rng.sample(range(size), size // 8), new)
            around = [[next(new) for _ in range(15 + len(items) % 4)] for _ in range(2)]
            docs.append((len(docs), " ".join([*around[0], *part, *around[1]])))
            items.append((len(items), " ".join(words)))
            kinds.append((kind, size, places))
    found = contamination.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id for r in found)
    met = {k: sum(kinds[r.doc_id] == k for r in found) / trials for k in EDITS}
    print(met)
    assert min(met.values()) >= 0.95, met


def test_long_items_are_cut_without_loss(spark):
    """A run across the border of two pieces, and a long item whose run is found in its last piece."""
    words = [f"w{i}" for i in range(5000)]
    docs = [(1, " ".join(words[1960:1999])), (2, " ".join(words[4978:])), (3, " ".join(words[1990:2007]))]
    found = contamination.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words)), (7, " ".join(words))], "item_id long, text string"), block_words=2000)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (2, 7)]


def test_stock_instructions_do_not_count(spark):
    head = "choose the statement that follows from the passage below and give no reason for it whatever you think of it dear reader"
    items = [(i, f"{head} " + " ".join(f"x{i}y{k}" for k in range(25))) for i in range(6)]
    docs = [(1, head + " and so on"), (2, "so " + items[3][1]), (3, " ".join(items[4][1].split()[-21:]))]
    found = contamination.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(2, 3), (3, 4)]


def test_leaks_against_brute_force(spark, data):
    docs, items = table(spark, data, "documents"), table(spark, data, "eval_items")
    got = {(r.doc_id, r.item_id) for r in contamination.leaked_items(docs, items).collect()}
    own = {r.item_id: np.array(r.words) for r in contamination.item_pieces(items).collect()}
    ids = __import__("cairn.llm.cgk", fromlist=["x"]).WordIds()
    grams = {}
    for item, w in own.items():
        for k in range(len(w) - 5):
            grams.setdefault(tuple(w[k : k + 6]), []).append((item, k))
    want = set()
    for r in docs.filter("text is not null").select("doc_id", "text").collect():  # one change in eight leaves six words in a row
        w = np.array([ids[x] for x in normal_words(r.text)], dtype=np.int64)
        for k in range(len(w) - 5):
            want |= {(r.doc_id, item) for item, q in grams.get(tuple(w[k : k + 6]), ()) if (r.doc_id, item) not in want and leaks(w, own[item], k - q - 4, k - q + 4, 20, 4)}
    assert want and got == want


def test_leaks_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "t", "en", None), (2, "t", "en", "few words")], "item_id long, task string, lang string, text string")
    assert contamination.leaked_items(docs, items).count() == 0
    assert contamination.leaked_items(docs, items.limit(0)).count() == 0
    assert {r.item_id: r.documents for r in contamination.leak_report(docs, items).collect()} == {1: 0, 2: 0}


def allocated(leaves, total):
    """Brute force: many small drops, each to the first open child by amount over weight, from the root down."""
    out, drop = dict.fromkeys(leaves, 0.0), total / 20_000
    held = lambda node: sum(v for p, v in out.items() if p[: len(node)] == node)
    weight = lambda node: sum(w for p, (w, _) in leaves.items() if p[: len(node)] == node)
    room = lambda node: sum(min(r, r if w else 0) for p, (w, r) in leaves.items() if p[: len(node)] == node)
    for _ in range(20_000):
        node = ()
        while len(node) < 3:
            open_ = [c for c in {p[: len(node) + 1] for p in leaves if p[: len(node)] == node} if weight(c) and held(c) + drop / 2 < room(c)]
            if not open_:
                return out
            node = min(open_, key=lambda c: (held(c) / weight(c), c))
        out[node] += drop
    return out


LEAVES = {("d", "en", "a"): (0.4, 10.0), ("d", "en", "b"): (0.2, 100.0), ("d", "de", "a"): (0.1, 30.0), ("d", "de", "b"): (0.1, 30.0), ("d", "fr", "a"): (0.2, 60.0), ("t", "en", "c"): (0.2, 100.0), ("t", "en", "f"): (0.05, 0.0), ("t", "fr", "c"): (0.05, 2.0)}


@pytest.mark.parametrize("total", [60.0, 1000.0])
def test_budgets_against_brute_force(spark, total):
    tree = spark.createDataFrame([(*p, int(r), w, r) for p, (w, r) in LEAVES.items()], "domain string, lang string, source string, tokens long, weight double, room double")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixture.budgets(tree, total).collect()}
    want = allocated(LEAVES, total)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 0.002 * total + 0.1 for p in want), (got, want)
    assert abs(sum(got.values()) - min(total, 332)) < 1e-6


def test_mixture(spark):
    rows = [(i, "word " * 20, "EN" if i % 2 else "de-XX", " Wiki" if i < 90 else "glossary") for i in range(100)] + [(100, None, "en", "wiki"), (101, "x", None, "other"), (1, "word " * 20, "en", "wiki")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("wiki", 0.5, 1), ("glossary", 0.49, 4), ("forum", 0.01, 3)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in mixture.mixture_shares(docs, targets).collect()}
    assert abs(shares["wiki"].actual_share - 0.505) < 0.03 and shares["glossary"].most_repeats == 4 and shares["forum"].tokens == 0
    used = {r.doc_id: r.repeats for r in mixture.mixed_documents(docs, targets).collect()}
    assert used == {r.doc_id: r.repeats for r in mixture.mixed_documents(docs, targets).collect()}  # seeded
    assert max(used.values()) <= 4 and all(used.get(i, 0) <= 1 for i in range(90))
    assert mixture.mixture_shares(docs.limit(0), targets).agg({"tokens": "sum"}).first()[0] == 0
    assert mixture.mixture_shares(docs, targets.limit(0)).count() == 0


def test_share_of_an_empty_source_goes_to_siblings(spark):
    sized = spark.createDataFrame([(1, "talk", "en", "chat_export", 2, 100), (2, "documentation", "en", "wiki", 2, 100)], "doc_id long, domain string, lang string, source string, max_repeats int, tokens long")
    targets = spark.createDataFrame([("chat_export", 0.1, 2), ("Chat-Export", 0.1, 3), ("wiki", 0.5, 2), ("forum", 0.3, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r.budget for r in mixture.budgets(mixture.leaves(sized, targets)).collect()}
    assert abs(got["chat_export"] - 200) < 1e-6 and abs(got["wiki"] - 200) < 1e-6 and got["forum"] == 0
    got = {r.source: r.budget for r in mixture.budgets(mixture.leaves(sized, targets), "all").collect()}
    assert abs(got["chat_export"] - 100) < 1e-6 and abs(got["wiki"] - 100) < 1e-6
