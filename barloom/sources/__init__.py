"""Raw archives, provider JSON, and the published store."""
