import pyarrow as pa

from rookery.llm import shingles


def test_a_text_has_one_set_wherever_it_stands(monkeypatch):
    texts = [b"a b c d e f g", "É x\ty\n z w A B".encode(), b"", b" ", b"one two", b"a " * 5_000]
    alone = [next(shingles.shingle_sets(pa.array([t]))).tolist() for t in texts]
    together = [s.tolist() for s in shingles.shingle_sets(pa.array([b"other words before", *texts, b"and after"]))][1:-1]
    monkeypatch.setattr(shingles, "SLICE_BYTES", 10)
    cut = [s.tolist() for s in shingles.shingle_sets(pa.array(texts))]
    assert alone == together == cut
    assert list(map(len, alone)) == [3, 3, 0, 0, 1, 1]


def test_letters_fold_and_words_differ():
    one = lambda t: next(shingles.shingle_sets(pa.array([t]))).tolist()
    assert one(b"A B C D E") == one(b"a  b\nc d e") != one(b"a b c d f")
    assert one(b"ab c") != one(b"a bc") and one(b"x") != one(b"x x") and one("É".encode()) != one("é".encode())
