"""The reader of text blocks against Python's own HTML parser, and elements that are not shown."""

import random
from html.parser import HTMLParser

import pytest

from glossmill.llm import htmlcut

rng = random.Random(31)
BLOCKS, INLINE = ["div", "p", "section", "h2", "blockquote", "figure"], ["b", "i", "em", "span", "a"]
HIDDEN = ["svg", "select", "template", "object", "math", "canvas", "noscript"]


def words():
    return " ".join(rng.choice(["one", "two &amp; three", "x &lt; y", "é", "語", "5 > 4"]) for _ in range(rng.randint(1, 4)))


def inline(depth=0):
    kind = rng.randint(0, 5)
    if kind < 3 or depth > 2:
        return words()
    if kind == 3:
        h = rng.choice(HIDDEN)
        return f"<{h} x='>'>{'<g>label</g>' * rng.randint(0, 2)}{f'<{h}>in</{h}>' if rng.random() < 0.3 else ''} gone</{h}>"
    if kind == 4:
        return rng.choice(["<br>", "<!-- a <p> b -->", "<script>if (a < b) '</p>'</script>", "<img alt='a>b'>"])
    t = rng.choice(INLINE)
    return f"<{t} title=\"a > b\">{inline(depth + 1)}</{t}>"


def block(depth=0):
    t = rng.choice(BLOCKS if depth < 3 else ["p"])
    inside = [inline() for _ in range(rng.randint(0, 3))]
    if t not in ("p", "h2") and depth < 3:
        inside += [block(depth + 1) for _ in range(rng.randint(0, 2))]
        rng.shuffle(inside)
    return f"<{t}>{' '.join(inside)}</{t}>"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.skip = [], [], 0

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN or tag == "script":
            self.skip += 1
        elif not self.skip:
            if tag in ("br", "img"):
                self.now.append(" ")
            elif tag not in INLINE:
                self.flush()

    def handle_endtag(self, tag):
        if tag in HIDDEN or tag == "script":
            self.skip -= 1
        elif not self.skip and tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def test_blocks_of_well_formed_pages():
    for _ in range(400):
        page = "<html><body>" + "\n".join(block() for _ in range(rng.randint(1, 4))) + "</body></html>"
        plain = Plain()
        plain.feed(page)
        plain.flush()
        assert [b[0] for b in htmlcut.blocks_of(page)] == plain.out, page


@pytest.mark.parametrize("tag", HIDDEN)
def test_unclosed_and_nested_elements_lose_no_text(tag):
    text = lambda html: [b[0] for b in htmlcut.blocks_of(html)]
    assert text(f"<article><p>one</p><{tag}><p>two</p></article><p>three</p>") == ["one", "two", "three"]
    assert text(f"<p>one</p><{tag}>a<{tag}>b</{tag}>c</{tag}><p>two</p>") == ["one", "two"]
    assert text(f"<p>one</p><{tag}/><p>two</p>{tag}</{tag}><p>three</p>") == ["one", "two", tag, "three"]
    assert text(f"<p>one</p><{tag}>" * 2000 + "<p>end</p>")[-1] == "end"


def test_a_block_ends_a_drawing_but_not_in_foreign_objects():
    text = lambda html: [b[0] for b in htmlcut.blocks_of(html)]
    assert text("<p>a</p><svg><text>x</text><p>b</p></svg><p>c</p>") == ["a", "b", "c"]
    assert text("<p>a</p><svg><foreignObject><p>x</p></foreignObject></svg><p>c</p>") == ["a", "c"]
    assert text("<p>a</p><select><option>x<p>y</p></select><p>c</p>") == ["a", "c"]
