"""What the tests share besides fixtures."""


def log_line(second, req, uid, new=False, status=200):
    """A request so many seconds after six in the morning."""
    clock = f"{6 + second // 3600:02d}:{second % 3600 // 60:02d}:{second % 60:02d}"
    given, sent = (f"c={uid}", "-") if new else ("-", f"c={uid}")
    return f"req:{req}\tuidset:{given}\tuidgot:{sent}\tstatus:{status}\ttime:07/Mar/2024:{clock} -0500"


def rows(df, *names):
    """Rows as tuples, in the order Spark returns them."""
    return [tuple(r) for r in (df.select(*names) if names else df).collect()]
