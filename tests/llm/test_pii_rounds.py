import numpy as np

from countspark.llm import pii


def test_labels_reach_the_end_of_long_skip_chains():
    n = 60
    shape = np.zeros((n, pii.FEATURES), bool)
    shape[0, 0] = True
    weights = np.zeros((pii.FEATURES, pii.LABELS))
    weights[0, 0] = 12.0
    skip = np.array([(i, i + 1) for i in range(n - 1)])
    nodes = pii.Nodes(np.zeros(n, int), np.arange(n), np.arange(n) + 1, shape, np.zeros((0, 2), int), skip)
    field = pii.Field(weights, np.zeros((pii.LABELS, pii.LABELS)), 8 * np.eye(pii.LABELS))
    move = np.exp(field.skip) / np.exp(field.skip).sum(1, keepdims=True)
    start = np.exp(weights[0] - weights[0].max())
    want = start / start.sum() @ np.linalg.matrix_power(move, n - 1)
    assert np.allclose(field.beliefs(nodes)[-1], want, atol=0.01)
    assert want[0] > 0.9
