"""rillhouse: real-time warehouse dataflows for an e-commerce business, on Spark."""
