"""DataFrame operators: filters, matching, ranking, survey, context, archive."""
