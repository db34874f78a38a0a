"""Event-time versions of batch operators; the batch result is their specification."""
