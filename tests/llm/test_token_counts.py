import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from countspark.llm import queries, token_counts


def greedy(word, starts, insides):
    """By the longest piece at each place; starts: pieces after the word mark, "" being the bare mark, which takes no character."""
    n, at, longest = 0, 0, max(map(len, starts | insides), default=0)
    begun = False
    while at < len(word) or not begun:
        vocabulary = insides if begun else starts
        end = next((e for e in range(min(len(word), at + longest), at - 1, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return None
        n, at, begun = n + 1, end, True
    return n


PIECES = st.sets(st.text(alphabet="abc", min_size=1, max_size=5), max_size=12)
STARTS = st.sets(st.text(alphabet="abc", max_size=5), max_size=12)


@settings(max_examples=400, deadline=None)
@given(STARTS, PIECES, st.text(alphabet="abc", max_size=14))
def test_as_greedy(starts, insides, word):
    got = token_counts.PieceCounter(starts, insides).count(word)
    assert got == greedy(word, starts, insides) or not word


def plain(word, vocabulary, longest):
    """Greedy longest match over a vocabulary as it is, from a word's mark on."""
    said, n = "▁" + word, 0
    while said:
        end = next((e for e in range(min(len(said), longest), 0, -1) if said[:e] in vocabulary), None)
        if end is None:
            return None
        said, n = said[end:], n + 1
    return n


def pieces(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


def test_query(spark, tmp_path):
    path = P.path("piece_bpe_32k.model")
    vocabulary = pieces(path)
    longest = max(map(len, vocabulary))
    rows = [(1, "The thing isn't unbelievably anticonstitutional"), (2, None), (3, ""), (4, "\U00013000 ok"), (5, "x" * 20000), (5, "x" * 20000), (None, "né né"), (6, "0 2024 中文 ç a▁b ▁ ▁▁x 1st")]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_words, r.n_unknown, r.n_tokens) for r in queries.op9_token_counts(spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        each = [plain(w, vocabulary, longest) for w in (t or "").split()]
        want.append((str(i), len(each), sum(x is None for x in each), sum(1 if x is None else x for x in each)))
    assert got == sorted(want)
    counter = token_counts.load(path)
    assert [counter.count(w) for w in ("thing", "0", "2024", "中文", "ç")] == [1, 2, 5, 3, 2]


def test_table_against_plain_matching(spark):
    path = P.path("piece_bpe_32k.model")
    vocabulary, counter = pieces(path), token_counts.load(path)
    longest = max(map(len, vocabulary))
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for w in (r.text or "").split()}
    assert [w for w in words if counter.count(w) != plain(w, vocabulary, longest)] == []


def test_empty(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), P.path("piece_bpe_32k.model")).count() == 0
