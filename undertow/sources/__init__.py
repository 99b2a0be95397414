"""Sources and sinks: Arrow streams, compact contracts, predictions and manifests."""
