"""Aligned tokens against the libraries' own answers for whole texts."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexweave.llm import _tokens, alignment  # noqa: E402

A, B, W = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, id string, key int, n int, pair string, links int"
ODD = [None, "", " ", "  \n\t ", "a", " a", "a ", "a  b", "a \n b", "tab\t x", "Don't 'stop'", "<|endoftext|> <s> <unk> <0x0A>", "a▁b", "İstanbul ΣΟΦΟΣ é 12.5% 中文字 🙂", "\x00\x1c \x7f\xa0 x", "z" * 700, "x  y", "nó  ."]


def noise(n, seed=5):
    rng = random.Random(seed)
    signs = [" "] * 12 + list("aabcdeESTsrdlmv019.,;:!?'\"-_()<|>\n\t\r\v\x1c\x85\xa0 ​▁éÉßİıΣσςñ́̈ﬁªµ中文🙂’—…²٣\x00") + ["'s", "'re ", "<|endoftext|>", "<0x0A>", "</s>", "  ", "\n\n", " \n ", "▁", " '", "ŉ"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), _tokens.TokenPairs(A, B)


def plain(texts):
    a, b, t = both()
    out = []
    for x in texts:
        x = x or ""
        ia, ib, whole = a.encode(" " + x, add_special_tokens=False).ids, b.encode(x), (" " + x).encode()
        if not x or any(b"".join(names[k] for k in ids) != whole for names, ids in ((t.a_bytes, ia), (t.b_bytes, ib))):
            out.append((0, 0, 0, [], ""))
            continue
        ends = []
        for names, ids in ((t.a_bytes, ia), (t.b_bytes, ib)):
            end, own = 0, []
            for k in ids:
                own.append((end, end + len(names[k]), k))
                end += len(names[k])
            ends.append(own)
        links = [(p, q) for s, e, p in ends[0] for u, v, q in ends[1] if s < v and u < e]
        common = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        groups = ";".join("|".join(",".join(str(k) for _, e, k in own if lo < e <= hi) for own in ends) for lo, hi in zip([0, *common], common, strict=False))
        out.append((len(ia), len(ib), len(common), links, groups))
    count = Counter(p for _, _, _, links, _ in out for p in set(links))
    most = {}
    for (p, _), n in count.items():
        most[p] = max(most.get(p, 0), n)
    return [(na, nb, ng, len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if na else "", g) for na, nb, ng, ls, g in out]


@pytest.mark.parametrize("sent", [alignment.SENT, 0])
def test_groups_links_and_counts(spark, monkeypatch, sent):
    monkeypatch.setattr(alignment, "SENT", sent)
    rows = list(enumerate(ODD + noise(250)))
    rows += [(None, "a b"), (None, "a b"), (3, "one id, another text"), rows[9], rows[9]]
    got = alignment.linked(spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(4), A, B, keep_groups=True)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"]
    got = sorted(((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in got.collect()), key=str)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows]), strict=True)), key=str)


def test_stretches_give_the_ids_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    for piece, kept in ((1 << 20, 1000), (40, 3)):  # also with texts cut into many runs, and a memory that forgets
        monkeypatch.setattr(_tokens, "PIECE", {1: piece, 5: piece})
        monkeypatch.setattr(_tokens, "REMEMBERED", {1: kept, 5: kept})
        texts = [t or "" for t in ODD] + noise(1500, seed=kept)
        whole = Tokenizer.from_file(W)
        for t, got in zip(texts, _tokens.WordIds(W).of(pa.array(texts)), strict=True):
            assert whole.encode(t, add_special_tokens=False).ids == got.tolist(), t


def test_every_token_of_the_vocabulary():
    a, _, t = both()
    words = [x.decode() for x in t.a_bytes if x.isascii()]
    words += [f"{w}é" for w in words[::7]] + [f"ß {w}" for w in words[::11]]
    got = [x[0].tolist() for x in t.of(pa.array(words))]
    assert len(words) > 40_000 and got == [e.ids if len(p) else [] for e, p in zip(a.encode_batch([" " + w for w in words], add_special_tokens=False), got, strict=True)]
    assert sum(not g for g in got) <= 1  # the empty word


def test_empty_table(spark):
    assert alignment.linked(spark.createDataFrame([], SCHEMA), A, B).collect() == []
