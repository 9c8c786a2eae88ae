"""Model spans that touch base spans."""

from trellis.llm import secrets_crf


class Tags:
    """Tags the given tokens: the first as a beginning, the others as its continuation."""

    def __init__(self, tokens):
        self.of = {k: secrets_crf.I if n else secrets_crf.B for n, k in enumerate(tokens)}

    def tags(self, classes, file):
        return self.of


def redacted(text, tokens):
    spans = secrets_crf.all_spans(text, Tags(tokens), secrets_crf.TokenClasses())
    return secrets_crf.redact(text, spans), spans


def test_the_rest_of_a_token_goes_too():
    text = "key " + "0a" * 12 + "xyz9 end"
    assert secrets_crf.base_spans(text) == [(4, 2, 28)]
    out, spans = redacted(text, [1])
    assert "xyz9" not in out and spans == [(4, 2, 28), (28, 3, 32)]


def test_a_second_secret_joined_to_a_base_match():
    text = "key " + "0a" * 12 + " Zq8vT2mKp4LwXz end"
    out, spans = redacted(text, [1, 2])
    assert "Zq8vT2mKp4LwXz" not in out and "end" in out and spans[1] == (29, 3, 43)


def test_a_span_inside_a_base_match_adds_nothing():
    text = "key " + "0a" * 12 + ". end"
    assert redacted(text, [1])[1] == secrets_crf.base_spans(text)
