"""Exports, dataset cards, manifests."""
