"""DataFrame operators: alignment, keys, comparison, profiles, rules, outliers, dashboards."""
