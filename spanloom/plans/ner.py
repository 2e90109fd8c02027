"""A token model as a scorer of the cascade: an ONNX graph with its tokenizer, loaded once in each worker."""

from __future__ import annotations

from typing import Any

import numpy as np

from spanloom.plans.cascade import LoadedOnce

#: Tokens that the graph takes at once, marks included; tokens that neighbouring windows share; windows in one call.
WINDOW, SHARED, AT_ONCE = 512, 128, 16


class TokenModel:
    """Texts -> (label, score, start, end) of runs of tokens with one label, over whole texts.

    A text longer than a window is read in windows that share tokens; a token counts in the window in whose middle it
    stands most. A run ends where the label changes and before a label that begins with B-; its score is the tokens' mean.
    """

    def __init__(self, session: Any, tokenizer: Any, labels: list[str], window: int = WINDOW, shared: int = SHARED) -> None:
        if not 0 <= shared < window - 2:
            raise ValueError(f"windows of {window} tokens cannot share {shared}")
        self.session, self.tokenizer, self.labels, self.window, self.shared = session, tokenizer, labels, window, shared
        self.inputs = {i.name for i in session.get_inputs()}
        self.first, self.last, self.pad = (next((i for n in names if (i := tokenizer.token_to_id(n)) is not None), None) for names in (("[CLS]", "<s>"), ("[SEP]", "</s>"), ("[PAD]", "<pad>")))

    def __call__(self, texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
        coded = [self.tokenizer.encode(t, add_special_tokens=False) for t in texts]
        windows = [(i, a) for i, c in enumerate(coded) for a in self._starts(len(c.ids))]
        probability = [np.zeros((len(c.ids), len(self.labels))) for c in coded]
        middle = [np.full(len(c.ids), -1) for c in coded]
        for at in range(0, len(windows), AT_ONCE):
            part = windows[at : at + AT_ONCE]
            for (i, a), p in zip(part, self._run([coded[i].ids[a : a + self._size()] for i, a in part])):
                depth = np.minimum(np.arange(len(p)), np.arange(len(p))[::-1])
                better = np.flatnonzero(depth > middle[i][a : a + len(p)])
                probability[i][a + better], middle[i][a + better] = p[better], depth[better]
        return [self._runs(p, c.offsets) for p, c in zip(probability, coded)]

    def _size(self) -> int:
        return self.window - 2

    def _starts(self, n: int) -> list[int]:
        step = self._size() - self.shared
        return list(range(0, max(1, n - self.shared), step)) if n else []

    def _run(self, ids: list[list[int]]) -> list[np.ndarray]:
        head, tail = [x for x in [self.first] if x is not None], [x for x in [self.last] if x is not None]
        rows = [[*head, *x, *tail] for x in ids]
        width = max(map(len, rows))
        tokens, mask = np.full((len(rows), width), self.pad or 0, np.int64), np.zeros((len(rows), width), np.int64)
        for k, r in enumerate(rows):
            tokens[k, : len(r)], mask[k, : len(r)] = r, 1
        feed = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
        logits = np.asarray(self.session.run(None, {k: v for k, v in feed.items() if k in self.inputs})[0], np.float64)
        e = np.exp(logits - logits.max(-1, keepdims=True))
        p = e / e.sum(-1, keepdims=True)
        return [p[k, len(head) : len(head) + len(x)] for k, x in enumerate(ids)]

    def _runs(self, p: np.ndarray, offsets: list[tuple[int, int]]) -> list[tuple[str, float, int, int]]:
        out: list[tuple[str, list[float], int, int]] = []
        before = None
        for best, row, (a, b) in zip(p.argmax(1).tolist() if len(p) else [], p, offsets):
            label = self.labels[best]
            kind = label.removeprefix("B-").removeprefix("I-")
            if label == "O":
                before = None
                continue
            if before == kind and not label.startswith("B-"):
                k, scores, start, _ = out[-1]
                out[-1] = (k, [*scores, float(row[best])], start, b)
            else:
                out.append((kind, [float(row[best])], a, b))
            before = kind
        return [(k, float(np.mean(s)), a, b) for k, s, a, b in out]


def onnx_scorer(model: str, tokenizer: str, labels: list[str], window: int = WINDOW, shared: int = SHARED) -> LoadedOnce:
    """A scorer from a graph's file and a tokenizer's file, on paths that every worker can read; nothing is loaded here."""

    def load() -> TokenModel:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # a task has one core
        return TokenModel(onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"]), Tokenizer.from_file(tokenizer), labels, window, shared)

    return LoadedOnce(load)
