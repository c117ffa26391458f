"""Content sort, turn repair and tokenizer alignment against brute force, with the odd cases."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import content_sort, cross_align, turn_repair
from tessera.llm.queries import ORACLES, QUERIES, tokenizer_path

DOCS = "doc_id long, text string, norm string, hash int, salt string, n int, slice int, kind string, row int"
TURNS = "conv_id long, turn long, role string, text string, m int, none string, at string, slice int, kind int"


def frame(spark, rows, ddl):
    width = ddl.count(",") + 1
    return spark.createDataFrame([(*r, *([None] * (width - len(r)))) for r in rows], ddl)


def key(row):
    return tuple((x is None, str(x)) for x in row)


def copies():
    r = random.Random(5)
    texts = [None, "", " ", "\t\n ", "a b", "a\tb", "a \x0b\r\n b", " a b", "a\u00a0b", "A b", "é 字\n字", "same start " * 30 + "x", "same start " * 30 + "y", "\x1ca b", "z" * 200_000]
    rows = [(i, texts[i % len(texts)]) for i in range(60)] + [(7, "a b"), (7, "a b"), (None, "a b"), (None, "only null"), (None, "only  null")]
    rows += [(100 + i, "hot  text" if i % 2 else "hot text") for i in range(200)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [2, 50, 10_000])
def test_exact_duplicates(spark, hot):
    rows = copies()
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in by.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    got = content_sort.exact_duplicates(frame(spark, rows, DOCS).repartition(5), hot_rows=hot)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert content_sort.exact_duplicates(frame(spark, [], DOCS)).count() == 0


def test_exact_duplicates_is_native(spark):
    plan = content_sort.exact_duplicates(frame(spark, copies(), DOCS), hot_rows=50)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    plain = content_sort.exact_duplicates(frame(spark, copies(), DOCS), hot_rows=10_000)._jdf.queryExecution().executedPlan().toString()
    assert plain.count("Exchange") == 1 and "rangepartitioning" in plain  # one exchange: the window reuses the ranges


def conversations():
    r = random.Random(9)
    texts = ["Yes.", "No", "Why?  ", "so what", "Wow!\n", "", " \t", "Fine. and", "é 字。"]
    rows = []
    for c in range(120):
        for t in range(r.randrange(9)):
            rows.append((c if c else None, t if r.random() > 0.1 else r.choice([None, 0, 3]), r.choice(["user", "assistant"] * 4 + ["system", "tool", "", "User", None]), r.choice(texts) + (str(r.randrange(9)) if r.random() < 0.4 else "") or None))
    for t in range(90):  # long, alternating with faults
        rows.append((500, t, ["user", "assistant"][t % 2], f"{r.choice(texts)}{r.randrange(30)}."))
    rows += [(501, None, r.choice(["user", "assistant"]), f"x{i}.") for i in range(30)]  # one turn for all
    rows += [(502, 3, "user", "Hi.")] * 40 + [(502, 4, "assistant", "Ho.")] * 3 + [(503, 1, "system", "Only this."), (504, 2, None, None), (505, 10**12, "user", "Far."), (505, -5, "user", "Near.")]
    r.shuffle(rows)
    return rows


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """Best (cost, audit) of each state after each row, with whole strings; every repeated row is a row of its own."""
    rows = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    need = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def insert(best):
        for q in (0, 1, 3, 2, 3):
            if q in best:
                role, to = need[q]
                cost, audit, out = best[q]
                one = (cost + 3, audit + "I", (*out, f"{role}:"))
                if to not in best or one[:2] < best[to][:2]:
                    best[to] = one
        return best

    best = insert({0: (0, "", ())})
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for q, (cost, audit, out) in best.items():
            arcs = [(q, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if (q, role[:1]) in legal:
                    arcs.append((legal[q, role[:1]], cost + more, audit + "K", (*out, f"{role}:{text}")))
                arcs.append((need[q][1], cost + 3 + more, audit + "R", (*out, f"{need[q][0]}:{text}")))
            for to, *one in arcs:
                if to not in new or tuple(one[:2]) < new[to][:2]:
                    new[to] = tuple(one)
        best = insert(new)
    cost, audit, out = min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])
    turns = {t for _, t, _, _ in rows if t is not None}
    codes = [r[2][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(codes, codes[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.mark.parametrize("bits", [2, 13])
def test_turn_repair(spark, bits):
    rows = conversations()
    by = {c: [] for c, *_ in rows}
    for x in damage(rows):
        by[x[0]].append(x)
    want = [(c, *brute_repair(x)) for c, x in by.items()]
    got = turn_repair.repair(frame(spark, rows, TURNS).repartition(3), bits=bits)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert any("I" in x[7] for x in want) and any("R" in x[7] for x in want)
    assert turn_repair.repair(frame(spark, [], TURNS)).count() == 0


def test_dial_is_the_shortest_distance():
    r = random.Random(2)
    for _ in range(50):
        n = r.randrange(1, 12)
        initial, fault = [r.randrange(4) for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        dist = [[10**9] * 4 for _ in range(n + 1)]  # by relaxing all arcs until nothing changes
        dist[n] = [0, 10**9, 10**9, 0]
        for _ in range(4 * n + 8):
            for i in range(n, -1, -1):
                for q in range(4):
                    arcs = [dist[i][turn_repair.NEED[q]] + 3]
                    if i < n:
                        arcs.append(dist[i + 1][q] + 4)
                        if fault[i] not in (1, 2):
                            more = 3 if fault[i] == 3 else 0
                            to = turn_repair.NEXT[q][initial[i]]
                            arcs += [dist[i + 1][turn_repair.NEED[q]] + 3 + more] + ([dist[i + 1][to] + more] if to is not None else [])
                    dist[i][q] = min(dist[i][q], *arcs)
        assert turn_repair.dial(initial, fault, turn_repair.END) == dist


def spoken():
    r = random.Random(3)
    syllables = ["ra", "ten", "low", "ing", "é", "字", "ß", "😀", "'s", "n't", "42", ".", ",", "\n", "\r\n", "  ", "\t", "\u00a0", "\u3000"]
    rows = [(i, " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 60)))) for i in range(80)]
    odd = [None, "", " ", "  ", "\n", " \n x", "x\n", "a  b   c ", "▁ mark ▁a", "<|endoftext|> <s> </s> <unk> <0x41>", "x\x00y \x1c z", "a;\r\n{\r b", "\x0b\x0c", "aaaa" * 500, "ab" * 3000, "字" * 400, "\t\t\tif x:\n\t\treturn", "İstanbul ﬁ Σας", "..." * 50]
    return rows + [(100 + i, t) for i, t in enumerate(odd)] + [(3, rows[3][1]), (None, rows[4][1]), (None, None)]


def brute_align(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(cross_align.A_MODEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(cross_align.B_MODEL))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    docs, count, top = [], Counter(), defaultdict(int)
    for i, t in rows:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(letter[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[1:-1], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs.append((i, [], [], []))
            continue
        ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 500 else _sums(x) for x in (bytes_a, bytes_b))
        ends = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in ends]
        for side, ids, where in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
            for x, e in zip(ids, where, strict=True):
                groups[bisect.bisect_left(ends, e)][side].append(x)
        docs.append((i, ids_a, ids_b, groups))
    for _, _, _, groups in docs:
        count.update({(x, y) for p, q in groups for x in p for y in q})
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for i, ids_a, ids_b, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    return out, count


def _sums(parts):
    total, out = 0, []
    for p in parts:
        total += len(p)
        out.append(total)
    return out


@pytest.mark.parametrize("per", [cross_align.SALT_LINKS, 3])
def test_cross_align(spark, monkeypatch, per):
    rows = spoken()
    want, count = brute_align(rows)
    docs = frame(spark, rows, DOCS).repartition(5)
    paths = tokenizer_path(cross_align.A_MODEL), tokenizer_path(cross_align.B_MODEL)
    got = cross_align.align(docs, *paths, per=per)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    if per == 3:
        counts = cross_align.pair_counts(cross_align.linked(docs, *paths), *paths, per=per)
        assert {(x.a_id, x.b_id): x.documents for x in cross_align.pairs(counts, *paths).collect()} == count
        assert cross_align.align(frame(spark, [], DOCS), *paths).count() == 0


def test_small_caches_change_nothing(monkeypatch):
    texts = [t for _, t in spoken()]
    paths = tokenizer_path(cross_align.A_MODEL), tokenizer_path(cross_align.B_MODEL)
    whole = cross_align.Aligner(*paths).slice(texts)
    monkeypatch.setattr(cross_align, "KNOWN", 3)
    monkeypatch.setattr(cross_align, "SIDE", 2)
    one = cross_align.Aligner(*paths)
    parts = [one.slice([t]) for t in texts]
    assert [p[1][0] for p in parts] == whole[1] and [p[0][0].tolist() for p in parts] == whole[0].tolist()
    assert sorted(((int(x) >> 16 << 16) + i, int(n)) for i, p in enumerate(parts) for x, n in zip(p[2], p[3], strict=True)) == list(zip(whole[2].tolist(), whole[3].tolist(), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    from tests.oracle import spark_rows, sql_rows

    assert spark_rows(QUERIES[name](spark, "/root/testdata/sf0.001")) == sql_rows(ORACLES[name], "/root/testdata/sf0.001")
