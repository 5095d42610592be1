"""The pipeline's rows, and each stage's, against a brute-force version of all five stages."""

import collections
import math
import random
import zlib

import corpus_pipeline as P
from itemloom.llm import lines, lm
from itemloom.llm.queries import tokenizer_path
from tests.llm.test_operators import WORDS, classes, corpus, plain_log_probabilities, rank, removed, same, shingles, whole_characters

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LABELS = [(i, 1, 0) for i in [*range(60), *range(200, 230), *range(300, 305)]] + [(3, 0, 0), (4, 1, 1), (5, None, 0), (None, 1, 0), (999, 1, 0)]


def documents():
    """The operators' corpus, pages that share a menu, near copies of pages, and texts of words that no one uses."""
    rng = random.Random(11)
    words = ["".join(rng.choice("mnoprst") for _ in range(rng.randrange(2, 7))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [r[:5] for r in corpus()]
    pages = [(200 + i, f"menu home\n{text(40)}\n\nmenu home\nbye ß", "en", "site", 0) for i in range(30)]
    rows += pages + [(260 + i, p[1].replace(words[i], "other"), "en", "s1", 0) for i, p in enumerate(pages[:8])]
    rows += [(300 + i, f"{text(12)}\n{pages[20 + i][1][30:140]} {text(9)}", "de", "site", 0) for i in range(5)]
    rows += [(400 + i, " ".join(f"zq{i}x{j}" for j in range(90)), rng.choice(["en", "de", None]), "site", 0) for i in range(6)]
    rng.shuffle(rows)
    return rows


def classified(rows):
    trusted = {i for i, *_ in LABELS if i is not None} - {3, 4, 5}
    own = [r[0] in trusted for r in rows]
    n = [len(WORDS.findall(r[1] or "")) for r in rows]
    nll = plain_log_probabilities([r[1] for r in rows], own)
    mean = lambda at: sum(nll[a] for a in at) / sum(n[a] for a in at)
    quantile = lambda x: sorted(x)[max(0, math.ceil(lm.QUANTILE * len(x)) - 1)]
    told = collections.defaultdict(list)
    for a, r in enumerate(rows):
        if own[a] and n[a]:
            told[r[2]].append(a)
    every = sum(told.values(), [])
    means, general = {k: mean(v) for k, v in told.items()}, mean(every)
    score = [(nll[a] + lm.PRIOR * means.get(r[2], general)) / (n[a] + lm.PRIOR) for a, r in enumerate(rows)]
    limits, limit = {k: quantile([score[a] for a in v]) for k, v in told.items()}, quantile([score[a] for a in every])
    return [r for a, r in enumerate(rows) if n[a] and score[a] <= limits.get(r[2], limit) + 1e-6]


def without_boilerplate(rows):
    counts, pages = collections.Counter(), collections.Counter()
    for _, text, _, source, _ in rows:
        if source is not None and text is not None:
            pages[source] += 1
            counts.update((source, x) for x in set(text.split("\n")) if x.strip(lines.BLANKS))
    drop = {k for k, n in counts.items() if n >= lines.MIN_PAGES and 100 * n > lines.MAX_PERCENT * pages[k[0]]}
    return [resized(r, "\n".join(x for x in r[1].split("\n") if (r[3], x) not in drop)) for r in rows]


def resized(r, text):
    return (r[0], text, *r[2:4], len(text))


def one_of_each(rows):
    sets = [shingles(r[1]) for r in rows]
    find, groups = classes(sets), collections.defaultdict(list)
    for a, r in enumerate(rows):
        groups[find(a) if sets[a] else -1 - a].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def without_repeats(rows):
    every = list(removed([(r[0], r[1].encode()) for r in rows], 50))
    return [resized(r, whole_characters(w, gone)) for r, (_, w, gone) in zip(rows, every)]


def packed(rows, pieces):
    """Each id of each document lies in one piece, and sequences have no gaps."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = [(r[0], [*t.encode(r[1], add_special_tokens=False).ids, 1]) for r in rows]
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    of = collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    want = collections.Counter()
    for i, x in ids:
        own = sorted({(a, n) for a, n, _ in of[i, len(x)]})
        assert sum(n for _, n in own) == len(x) and [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        want.update((i, len(x), a, n, crc(x[a : a + n])) for a, n in own)
    same([(p.doc_id, p.doc_tokens, p.start, p.length, p.ids_crc32) for p in pieces], list(want.elements()))
    used = collections.defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append((p.offset, p.length))
    for v in used.values():
        v.sort()
        assert [a for a, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048


BRUTE_FORCE = {"quality_classifier": classified, "line_dedup": without_boilerplate, "jaccard_join": one_of_each, "suffix_dedup": without_repeats}


def test_stages(spark, tmp_path):
    want = documents()
    spark.createDataFrame(want, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs, before = spark.read.parquet(f"{tmp_path}/{name}"), want
        want = BRUTE_FORCE[name](want)
        assert docs.columns == COLUMNS and (len(want), sum(len(r[1]) for r in want)) < (len(before), sum(len(r[1] or "") for r in before)), name
        same([tuple(r) for r in docs.collect()], want)
    packed(want, P.STAGES[-1][1](spark, docs, str(tmp_path)).collect())
    packed(want, P.run(spark, str(tmp_path)).collect())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
