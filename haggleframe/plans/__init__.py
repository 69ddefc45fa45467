"""Queries over the market tables; importing the modules registers them."""

from haggleframe.plans import batches, catalog, editions, events, identity, lifecycle, linking, market, relational, relevance, revalidation, rules, scout, screens, streams, texts, workflow  # noqa: F401
