"""A client of the service: its tables as free leaves, and expressions computed over there."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from typing import Any

from ..plans.expr import Expr, symbol
from ..plans.tree import to_tree


class Client:
    def __init__(self, url: str, authorization: str | None = None, timeout: float = 600):
        self.url, self.authorization, self.timeout = url.rstrip("/"), authorization, timeout

    def _ask(self, path: str, body: Any = None, accept: str = "application/json") -> Any:
        head = {"Content-Type": "application/json", "Accept": accept} | ({"Authorization": self.authorization} if self.authorization else {})
        request = urllib.request.Request(self.url + path, None if body is None else json.dumps(body).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as got:
                return json.loads(got.read()) if accept == "application/json" else got.read()
        except urllib.error.HTTPError as err:
            told = json.loads(err.read() or b"{}").get("error", "")
            raise RuntimeError(f"{err.code}: {told}") from err

    @property
    def dshape(self) -> dict:
        return self._ask("/datashape")

    def leaf(self, name: str) -> Expr:
        """A table of the service as a leaf; in nested catalogs by ``a/b``."""
        shape: Any = self.dshape
        for part in name.split("/"):
            shape = shape[part]
        return symbol(name, shape)

    def compute(self, e: Expr, profile: bool = False, compute_kwargs: dict | None = None, odo_kwargs: dict | None = None) -> dict:
        """The answer of the service: ``datashape``, ``names`` and ``data``."""
        names = {leaf: leaf._name for leaf in e.leaves()}
        more = {"profile": profile, "compute_kwargs": compute_kwargs, "odo_kwargs": odo_kwargs}
        return self._ask("/compute", {"expr": to_tree(e, names)} | {k: v for k, v in more.items() if v})

    def compute_arrow(self, e: Expr):
        """The rows of an expression as an Arrow table."""
        import pyarrow as pa

        names = {leaf: leaf._name for leaf in e.leaves()}
        return pa.ipc.open_stream(self._ask("/compute", {"expr": to_tree(e, names)}, "application/vnd.apache.arrow.stream")).read_all()

    def add(self, **sources: str) -> dict:
        return self._ask("/add", sources)

    def table(self, name: str, spark):
        """A table of the service, fetched whole through the driver as an Arrow stream, as a DataFrame."""
        got = self.compute_arrow(self.leaf(name))
        if not got.num_rows:  # Spark takes no empty columns of arrays
            from pyspark.sql.pandas.types import from_arrow_schema

            return spark.createDataFrame([], from_arrow_schema(got.schema))
        return spark.createDataFrame(got)
