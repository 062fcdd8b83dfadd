import re
from collections import Counter

from statewright.llm.quality import cleaned

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), failed


def result(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in cleaned(df).collect()}


def test_base_equals_brute_force_on_documents(documents, frame):
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert result(documents) == {i: brute(t) for i, t in texts.items()}
    odd = {1: None, 2: "", 3: "\n\n \n", 4: "a\na\n\na \na", 5: "x x x", 6: "x x x x", 7: "é|ü\r\né|ü\r\n", 8: "one two three " * 20_000, 9: "a b c\n" * 3, 10: "\n"}
    assert result(frame(odd)) == {i: brute(t) for i, t in odd.items()}
    assert cleaned(frame({})).count() == 0


def test_verdict_follows_the_quality_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = [(r.kept, labels[r.doc_id]) for r in cleaned(docs, with_text=False).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(k for k, good in found if good) / sum(good for _, good in found) > 0.99
    assert sum(not k for k, good in found if not good) / sum(not good for _, good in found) > 0.8


def test_lines(frame):
    good = "This line is fine and has its words."
    bad = ["no end", "Home | News | About | Contact.", "we ### use ### marks ###.", "ALL OF THIS IS LOUD.", "la la la la la la la la la la la.", "Click here for more.", good]
    text = "\n".join([good, *bad, "", "Another fine line of words."])
    clash = frame({1: text}).selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS clean_text")
    row = cleaned(clash).first()
    assert row.clean_text == f"{good}\n\nAnother fine line of words." and row.n_failed_lines == len(bad)


def failed_lines(frame, *lines):
    rows = cleaned(frame(dict(enumerate(lines)))).collect()
    return [r.n_failed_lines for r in sorted(rows, key=lambda r: r.doc_id)]


def test_characters_of_several_bytes(frame):
    assert failed_lines(frame, "ce montant est dû au bailleur", "ce montant est du au bailleur", "il a dit « oui »", "he said “yes”", "and so on…", "plain dë") == [1, 1, 0, 0, 0, 1]
    loud = "ВСЕ ЭТИ СЛОВА ГРОМКО НАПИСАНЫ."
    assert failed_lines(frame, loud, loud.lower(), "ÀÉÎ ÕÜÇ ÀÉÎ ÒÙÈ.", "2 × 3 ÷ 4 × 5.", "àéî × ÷ ×ÕÜ õüç.") == [1, 0, 1, 0, 0]
    assert failed_lines(frame, "one · two · three · four.", "one • two › three • four.", "one Ă two Ă three Ă four.") == [1, 1, 0]


def test_a_phrase_in_a_long_line_is_text(frame):
    words = " ".join(f"word{k}" for k in range(100))
    assert failed_lines(frame, f"{words} about cookies.", "We use cookies.") == [0, 1]


def test_lines_and_words_that_a_polynomial_confuses(frame):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = {1: f"{word}\n{other}\n{word}", 2: f"{word} x y {other} x y {word} x y"}
    for length in (1024, 4096):
        cut = {i: t.replace(word, word[:length]).replace(other, other[:length]) for i, t in texts.items()}
        assert result(frame(cut)) == {i: brute(t) for i, t in cut.items()}
