"""Sources and sinks: raw markdown, media, manifests, state, registry and request logs."""
