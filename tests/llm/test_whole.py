"""Inputs of which a part was lost."""

import pytest

from backtrail.llm import html_tree, media_mpeg

TEXT = "These are some words of a paragraph to read, and more of them."


@pytest.mark.parametrize("mark", [b"TAG", b"APETAGEX"])
def test_payload_is_no_tag(mark):
    # at every place of a payload in one frame, and around the end of longer ones
    for size, places in ((64, range(56)), (128, range(120)), (1408, range(1200, 1400)), (6400, range(6200, 6392))):
        for at in places:
            payload = b"x" * at + mark + b"x" * (size - at - len(mark))
            stored = media_mpeg.write(payload)
            assert media_mpeg.payload_of(stored, media_mpeg.parse(stored)) == payload


@pytest.mark.parametrize("start", ["<html><head><title>T</title>", "<head><meta charset=x><head>", "<html><head><style>p{}</style><body>", "<head><script>1</script><body><head>"])
def test_head_without_end(start):
    model = html_tree.default_model()
    assert model.extract([f"{start}<article><h1>Of A</h1><p>{TEXT}</p></article>"]) == [f"Of A {TEXT}"]
    assert html_tree.Page(f"{start}<b>{TEXT}</b>").segments[0][1] == TEXT
    assert html_tree.Page(f"{start}{TEXT}").segments[0][1] == TEXT


def test_formulas_and_drawings_are_text():
    formula = "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>"
    drawing = '<svg viewBox="0 0 1 1"><title>t</title><path d="M0"/><text>Left</text><text>Right</text></svg>'
    page = f"<body><article><p>{TEXT} Here {formula} holds.</p><p>{TEXT} {drawing} end</p><svg/><p>{TEXT}</p></article></body>"
    assert html_tree.default_model().extract([page]) == [f"{TEXT} Here x=2 holds. {TEXT} Left Right end {TEXT}"]


def test_text_right_under_body():
    model = html_tree.default_model()
    pages = [f"<html><head><title>T</title></head><body>{TEXT}</body></html>", f"<html><head></head><body>{TEXT}<br>{TEXT}<p>{TEXT}</p></body></html>"]
    assert model.extract(pages) == [TEXT, f"{TEXT} {TEXT} {TEXT}"]
