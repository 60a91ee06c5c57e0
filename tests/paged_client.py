"""A collection of 1,234 tags that answers in pages, as the data source sees it."""

ROWS = [{"id": k, "kind": "odd" if k % 2 else "even", "name": f"tag {k}"} for k in range(1, 1235)]


def fetch(page, per_page, where):
    found = [r for r in ROWS if all(r[c] in v for c, v in where.items())]
    return len(found), found[(page - 1) * per_page : page * per_page]


def broken(page, per_page, where):
    raise OSError("the server is gone")
