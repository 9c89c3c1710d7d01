"""Engines that tests name as `engines_for_tests:maker`."""


class Reader:
    """Takes a file's bytes for its transcript: lines of `speaker start word word ...`, half a second a word."""

    def transcribe(self, path, content):
        out = []
        for line in bytes(content or b"").decode().splitlines():
            speaker, start, *words = line.split()
            at = float(start)
            out.append({"start": at, "end": at + 0.5 * len(words), "text": " ".join(words), "speaker": speaker, "words": [{"start": at + 0.5 * i, "end": at + 0.5 * i + 0.5, "word": w} for i, w in enumerate(words)]})
        return out


class Sides:
    """Two speakers, left and right, by the first component."""

    def score_candidates(self, vector):
        p = min(max((float(vector[0]) + 1) / 2, 0.0), 1.0)
        return [{"speaker": "left", "score": 1 - p}, {"speaker": "right", "score": p}]


def reader():
    return Reader()


def sides():
    return Sides()
