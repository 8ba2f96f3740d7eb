from inkgrid.llm import secrets as S

SECRET = "wJalrXUtnFEMI7K7MDENGbPxRfiCYz"


def test_nearer_complement_in_another_scope_hides_none():
    for text in (f"user_id: alice1\n\n{SECRET}    account_id: 12345", f"account_id: 12345    {SECRET}\n\nuser_id: alice1"):
        spans, links = S.linked(text, S.base_spans(text))
        assert sorted(s[0] for s in spans) == ["identifier", "secret"]
        assert [[text[slice(*name[1:])] for name in names] for _, _, names, _, _ in links] == [["12345"]]
