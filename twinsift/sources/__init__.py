"""Sources and sinks: file trees, images, hash snapshots, settings, reports."""
