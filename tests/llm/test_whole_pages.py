"""Extraction keeps the text around and in foreign and embedded elements."""

import pytest

from leafmill.llm import extraction


@pytest.mark.parametrize(
    "inside, kept",
    [
        ('<p>One.</p><svg class="i"/><p>Two.</p>', "One. Two."),
        ("<p>One.</p><SVG a='>' /><p>Two.</p><svg><text>no</text></svg><p>Three.</p>", "One. Two. Three."),
        ("<p>One <math/>and two.</p>", "One and two."),
        ('<p>One <object data="a"/>and two.</p>', "One and two."),
        ("<p>Sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> here.</p>", "Sum x+1 here."),
        ('<p>See <object data="a.pdf">the fallback</object> here.</p>', "See the fallback here."),
        ("<p>One.</p><script/>no</script><p>Two.</p>", "One. Two."),
    ],
)
def test_elements_in_text(inside, kept):
    assert " ".join(b[0] for b in extraction.blocks(f"<article>{inside}</article>")) == kept
