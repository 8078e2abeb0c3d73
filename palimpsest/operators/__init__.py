"""Operators over DataFrames: manifests, observations, profiles, evidence, policies, records, arrivals, inference."""
