"""Physical plan text through the public ``explain`` API."""

import contextlib
import io


def physical_plan(df, mode="simple"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()
