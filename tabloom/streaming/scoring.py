"""Scoring a stream with the plan of the batch scorer; it keeps no state between rows."""

from tabloom.operators.score import score


def score_stream(scorer, stream, keep=(), strict=False):
    """Predictions and warnings for a streaming DataFrame.

    Unusable rows are marked by default, so that one of them does not end the stream.
    """
    if not stream.isStreaming:
        raise ValueError("Give a streaming DataFrame")
    return score(scorer, stream, keep, strict)
