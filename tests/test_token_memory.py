from surfaceworks.functions import ordered_json as J


def test_an_encoder_gets_few_texts_at_once(monkeypatch):
    monkeypatch.setattr(J, "COUNT_CHARS", 10)
    texts, given = ["abc", "", "abcdefgh", "a" * 50, "ab", "abcdefgh", "x"], []
    assert J.counted(texts, lambda some: given.append(some) or some) == [3, 0, 8, 50, 2, 8, 1] and J.counted([], list) == []
    assert [x for some in given for x in some] == texts and all(sum(map(len, some)) <= 10 or len(some) == 1 for some in given)
