"""An analytics engine on Spark for evidence-bounded event attribution."""
