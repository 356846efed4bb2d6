"""Queries over role views, gathered in catalogues."""

from . import evaluation, extended, matching, relational, workflow

CATALOGUES = [relational.catalogue, evaluation.catalogue, matching.catalogue, workflow.catalogue, extended.catalogue]
