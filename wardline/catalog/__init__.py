"""Every operator as a named query over the given tables, with its SQL counterpart."""

from wardline.catalog import (  # noqa: F401  (importing registers the queries)
    chats,
    documents,
    files,
    gates,
    keys,
    retrieval,
    rewards,
    streams,
    training,
)
from wardline.catalog.registry import QUERIES, SQL  # noqa: F401
