"""Distributed operators: batch gradient, update rules, trainers, SVRG walks, wide mode, validation, scoring, metrics."""
