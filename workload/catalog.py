"""All registered queries."""

from workload import loads, market, spaces, stores, text

ALL = {**text.QUERIES, **market.QUERIES, **loads.QUERIES, **stores.QUERIES, **spaces.QUERIES}
