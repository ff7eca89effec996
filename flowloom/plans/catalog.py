"""All registered queries."""

from __future__ import annotations

from flowloom.plans import catalog_packing, catalog_payload, catalog_scale, catalog_stream, catalog_wire

QUERIES = {**catalog_wire.QUERIES, **catalog_payload.QUERIES, **catalog_packing.QUERIES, **catalog_stream.QUERIES,
           **catalog_scale.QUERIES}
