"""What a statement is called and which request of a vector store's REST interface it stands for."""

from __future__ import annotations

from typing import Any
from urllib.parse import quote

from sparkseek import nodes as n
from sparkseek.nodes import to_json

#: A statement's type, method and path.
ROUTES = {
    n.Scroll: ("scroll", "POST", "/collections/{collection}/points/scroll"),
    n.Count: ("count", "POST", "/collections/{collection}/points/count"),
    n.Upsert: ("upsert", "PUT", "/collections/{collection}/points"),
    n.Delete: ("delete", "POST", "/collections/{collection}/points/delete"),
    n.UpdatePayload: ("update_payload", "POST", "/collections/{collection}/points/payload"),
    n.ClearPayload: ("clear_payload", "POST", "/collections/{collection}/points/payload/clear"),
    n.DeletePayload: ("delete_payload", "POST", "/collections/{collection}/points/payload/delete"),
    n.UpdateVector: ("update_vector", "PUT", "/collections/{collection}/points/vectors"),
    n.DeleteVector: ("delete_vector", "POST", "/collections/{collection}/points/vectors/delete"),
    n.CreateCollection: ("create_collection", "PUT", "/collections/{collection}"),
    n.AlterCollection: ("update_collection", "PATCH", "/collections/{collection}"),
    n.DropCollection: ("drop_collection", "DELETE", "/collections/{collection}"),
    n.CreateIndex: ("create_index", "PUT", "/collections/{collection}/index"),
    n.DropIndex: ("drop_index", "DELETE", "/collections/{collection}/index/{field}"),
    n.CreateShardKey: ("create_shard_key", "PUT", "/collections/{collection}/shards"),
    n.DropShardKey: ("drop_shard_key", "POST", "/collections/{collection}/shards/delete"),
    n.ShowShardKeys: ("show_shard_keys", "GET", "/collections/{collection}/shards"),
    n.ShowCollections: ("show_collections", "GET", "/collections"),
    n.ShowCollection: ("show_collection", "GET", "/collections/{collection}"),
}


def route(s: Any) -> tuple[str, str | None, str | None]:
    """(type, method, path); CROSS RERANK is done by the client and has no request."""
    if isinstance(s, n.Query):
        if isinstance(s.expr, n.CrossRerank):
            return "cross_rerank", None, None
        points = f"/collections/{quote(s.collection)}/points"
        if isinstance(s.expr, n.Points):
            return "points", "POST", points
        return ("query_groups", "POST", f"{points}/query/groups") if s.group else ("query", "POST", f"{points}/query")
    kind, method, path = ROUTES[type(s)]
    collection = getattr(s, "collection", None) or getattr(s, "name", None) or ""
    return kind, method, path.format(collection=quote(collection), field=quote(getattr(s, "field", None) or ""))


def compiled(s: Any) -> dict[str, Any]:
    kind, method, path = route(s)
    return {"stmt_type": kind, "method": method, "path": path, "payload": to_json(s) if method not in ("GET", "DELETE") else None}
