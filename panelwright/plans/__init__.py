"""Plans made of operators: orders, configurations, pipelines, routing, reports."""
