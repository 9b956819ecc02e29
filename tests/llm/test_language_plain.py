"""Predictions of the network against one that takes a byte at a time."""

import math

import numpy as np

from haplospark.llm.langid import HIDDEN, WINDOW, BiGRU, identify_language

TEXTS = ["the cat sat on the mat " * 9, "über Öl", "x", "a" * WINDOW, "b" * (WINDOW + 1), "日本語 text 1 2 3 " * 30, "12 34", "", None, "ñandú"]


def slow_states(w, way, data):
    h, out = [0.0] * HIDDEN, []
    for byte in data:
        gate = [float(w[f"E{way}"][j, byte]) for j in range(3 * HIDDEN)]
        z = [1 / (1 + math.exp(-(gate[j] + sum(float(w[f"U{way}"][j, k]) * h[k] for k in range(HIDDEN))))) for j in range(2 * HIDDEN)]
        reset, update = z[:HIDDEN], z[HIDDEN:]
        held = [r * x for r, x in zip(reset, h)]
        new = [math.tanh(gate[2 * HIDDEN + j] + sum(float(w[f"U{way}"][2 * HIDDEN + j, k]) * held[k] for k in range(HIDDEN))) for j in range(HIDDEN)]
        h = [a + u * (b - a) for a, u, b in zip(h, update, new)]
        out.append(h)
    return out


def slow_probabilities(model, text):
    data, total = text.encode(), np.zeros(len(model.languages))
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW]
        ahead = slow_states(model.w, "f", part)
        # backwards the network begins at the window's last place, behind the text as zero bytes
        back = slow_states(model.w, "b", (part + bytes(WINDOW - len(part)))[::-1])[::-1]
        for x, y in zip(ahead, back):
            z = model.w["V"].astype(float) @ np.array([*x, *y]) + model.w["c"][:, 0]
            p = np.exp(z - z.max())
            total += p / p.sum()
    return total / len(data)


def test_predictions_equal_a_plain_network(spark):
    model = BiGRU(["de", "en", "es"], seed=4)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(df, model).collect()}
    for i, text in enumerate(TEXTS):
        if not text or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        p = slow_probabilities(model, text)
        assert abs(got[i][1] - p.max()) < 1e-4 and (got[i][0] == model.languages[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4)
