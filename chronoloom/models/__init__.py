"""One-step-ahead forecasters. Each returns (keys, step, date, model, pred) for the newest `horizon` rows."""
